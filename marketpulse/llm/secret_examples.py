"""Labelled findings for the forest of `secrets`, made from forms: what is a secret is known from how a text was made.

Every form is a text with one value in it. Candidates that overlap the value of a secret's form
are positives; all candidates of the other forms, and all others, are negatives. The negatives
are those that a rule on names and entropy takes for secrets, or nearly so: digests in paths
and next to their names, identifiers, data addresses, placeholders, calls and names as values.

EACH values per form and a seed give a fixed, bounded table of (finding, before, label, form).
"""

from __future__ import annotations

import base64
import random
import uuid
from collections.abc import Callable

EACH = 80

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _LOWER + _LOWER.upper() + "0123456789"
_WORDS = (
    "account admin alpha amber anchor archive autumn batch beacon bridge buffer cache camera canvas castle cedar channel client cloud cluster cobalt comet config copper "
    "data delta deploy digest document dragon eagle engine event falcon feature field file filter forest garden gateway granite graph handler harbor hunter index island jacket "
    "kernel lantern layer library lemon letter linear listener local magnet manager maple marble market matrix meadow memory mirror model module monitor moon mountain network "
    "node number object ocean office orange page palace panel parser path pepper planet portal process public query queue rabbit record region report request river rocket "
    "route sample schema school search server service session shadow signal silver source spring station status storage stream summer system table target task template thread "
    "ticket tiger timber token tower train unit update user value vector violet virtual walnut water weather window winter worker yellow zebra"
).split()


def _pick(rng: random.Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))


def _hex(rng: random.Random, *sizes: int) -> str:
    return _pick(rng, "0123456789abcdef", rng.choice(sizes))


def _base64(rng: random.Random, low: int, high: int) -> str:
    return base64.b64encode(rng.randbytes(rng.randint(low, high))).decode()


def _opaque(rng: random.Random) -> str:
    kind = rng.randrange(6)
    if kind < 2:
        return _hex(rng, 32, 40, 40, 64)
    if kind == 2:
        return _base64(rng, 18, 48)
    return _pick(rng, _ALNUM + ("-_" if kind == 3 else ""), 20, 44)


def _keyed(rng: random.Random) -> str:
    """The prefixes that providers give their keys."""
    return rng.choice(
        [
            lambda: "AKIA" + _pick(rng, _LOWER.upper() + "234567", 16),
            lambda: f"gh{rng.choice('pousr')}_" + _pick(rng, _ALNUM, 36),
            lambda: f"sk_{rng.choice(['live', 'test'])}_" + _pick(rng, _ALNUM, 24),
            lambda: f"xox{rng.choice('abprs')}-" + _pick(rng, "0123456789", 12) + "-" + _pick(rng, _ALNUM, 24),
            lambda: "eyJ" + _pick(rng, _ALNUM, 30) + ".eyJ" + _pick(rng, _ALNUM, 60) + "." + _pick(rng, _ALNUM + "-_", 43),
        ]
    )()


def _password(rng: random.Random) -> str:
    """What people choose: words in a row with signs or digits, or words with letters replaced."""
    words = [rng.choice(_WORDS) for _ in range(rng.randint(2, 3))]
    if rng.random() < 0.5:
        return rng.choice("-!#.+").join(w.title() if rng.random() < 0.5 else w for w in words) + rng.choice(["", str(rng.randrange(100))])
    swapped = words[0].translate(str.maketrans("aeo", "430")) + words[1].translate(str.maketrans("aio", "@10"))
    return (swapped + str(rng.randrange(1, 9999)))[: rng.randint(9, 18)]


def _short(rng: random.Random) -> str:
    return rng.choice(_WORDS)[:4].translate(str.maketrans("aeo", "430")) + _pick(rng, _ALNUM, 4, 6) + str(rng.randrange(10))


def _name(rng: random.Random, signs: str = "_-") -> str:
    sign = rng.choice(signs)
    return sign.join(rng.choice(_WORDS) for _ in range(rng.randint(2, 4))) + rng.choice(["", f"{sign}{rng.randrange(20)}", f"{sign}v{rng.randrange(1, 9)}"])


def _camel(rng: random.Random) -> str:
    return rng.choice(_WORDS) + "".join(rng.choice(_WORDS).title() for _ in range(3)) + str(rng.randrange(100))


def _path(rng: random.Random) -> str:
    return "/".join([_name(rng) for _ in range(rng.randint(2, 4))]) + f"{rng.randrange(100)}" + rng.choice([".py", ".json", ".html", "", "/"])


def _placeholder(rng: random.Random) -> str:
    kind = rng.randrange(5)
    if kind == 0:
        return f"your-{rng.choice(['api', 'secret', 'access'])}-{rng.choice(['key', 'token'])}-{rng.choice(['here', 'goes-here', '123', '1'])}"
    if kind == 1:
        return rng.choice("xX*0.") * rng.randint(8, 40)
    if kind == 2:
        return f"<{_name(rng, '-_')}>"
    if kind == 3:
        return "${" + _name(rng, "_").upper() + "}"
    return rng.choice(["changeme", "placeholder", "replace-me", "insert-here", "dummy"]) + str(rng.randrange(10, 1000))


def _secret_name(rng: random.Random) -> str:
    name = rng.choice(["token", "token", "secret", "api_key", "apikey", "access_key", "private_key", "auth_token", "client_secret", "access_token", "secret_key", "credential", "bearer"])
    name = rng.choice(["", "", f"{rng.choice(_WORDS)}_"]) + name
    return rng.choice([name, name.upper(), name.replace("_", "-")])


def _password_name(rng: random.Random) -> str:
    name = rng.choice(["", "", f"{rng.choice(_WORDS)}_"]) + rng.choice(["password", "passwd", "pwd"])
    return rng.choice([name, name.upper()])


def _prose(rng: random.Random) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(1, 6)))


def _assigned(rng: random.Random, name: str, value: str, quoted: bool = False) -> str:
    forms = [f'{name} = "{value}"', f"{name}: '{value}'", f'{{"{name}": "{value}"}}', f'{name}="{value}"']
    return rng.choice(forms if quoted else [*forms, f"{name}={value}", f"export {name}={value}\n", f"{name}: {value}", f"https://host.test/{rng.choice(_WORDS)}?user=me&{name}={value}&x=1"])


def _block(rng: random.Random) -> str:
    body = "\n".join(_pick(rng, _ALNUM + "+/", 64) for _ in range(rng.randint(2, 24)))
    kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}" + rng.choice(["", f"\n-----END {kind}PRIVATE KEY-----"])


#: (form, is a secret, value, text around a value)
_Form = tuple[str, bool, Callable[[random.Random], str], Callable[[random.Random, str], str]]
FORMS: list[_Form] = [
    ("opaque value", True, _opaque, lambda r, v: _assigned(r, _secret_name(r), v)),
    ("opaque quoted value", True, _opaque, lambda r, v: _assigned(r, _secret_name(r), v, True)),
    ("hex value", True, lambda r: _hex(r, 32, 40, 64), lambda r, v: _assigned(r, _secret_name(r), v, True)),
    ("long value", True, lambda r: _pick(r, _ALNUM + "$%&!#", 80, 300), lambda r, v: _assigned(r, _secret_name(r), v, True)),
    ("base64 value", True, lambda r: _base64(r, 12, 48), lambda r, v: _assigned(r, _secret_name(r), v)),
    ("encoded words", True, lambda r: base64.b64encode(_name(r, "-").encode()).decode(), lambda r, v: _assigned(r, _secret_name(r), v, True)),
    ("secret access key", True, lambda r: _base64(r, 30, 30), lambda r, v: _assigned(r, r.choice(["AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "secret_access_key"]), v)),
    ("provider's key", True, _keyed, lambda r, v: _assigned(r, _secret_name(r), v)),
    ("key id", True, _keyed, lambda r, v: _assigned(r, r.choice(["AWS_ACCESS_KEY_ID", "key_id", "id", "login"]), v)),
    ("provider's key in prose", True, _keyed, lambda r, v: f"{_prose(r)} {v} {_prose(r)}"),
    ("bearer", True, _opaque, lambda r, v: f"Authorization: Bearer {v}"),
    ("chosen password", True, _password, lambda r, v: _assigned(r, _password_name(r), v, True)),
    ("replaced letters", True, _short, lambda r, v: _assigned(r, _password_name(r), v)),
    ("generated password", True, lambda r: _pick(r, _ALNUM + "!#%+-", 12, 24), lambda r, v: _assigned(r, _password_name(r), v, True)),
    ("key block", True, _block, lambda r, v: f"{_prose(r)}\n{v}\n"),
    ("named digest", False, lambda r: _hex(r, 32, 40, 64), lambda r, v: f"{r.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'digest', 'revision', 'etag', 'hash', 'blob'])}{r.choice([' ', ': ', '=', ' = '])}{v}"),
    ("quoted digest", False, lambda r: _hex(r, 32, 40, 64), lambda r, v: f'"{r.choice(["sha256", "md5", "checksum", "digest", "rev", "etag", "hash", "fingerprint"])}": "{v}"'),
    ("digest in a path", False, lambda r: f"{r.choice(_WORDS)}/{_hex(r, 2)}/{_hex(r, 32, 38)}", lambda r, v: f"{r.choice(['path', 'file', 'see', 'url'])}: {v}"),
    ("digest in an address", False, lambda r: f"host.test/{_name(r)}/{_hex(r, 32, 40)}", lambda r, v: f"https://{v}.{r.choice(['png', 'js', 'html'])}"),
    ("integrity", False, lambda r: f"sha{r.choice([256, 384, 512])}-{_base64(r, 32, 64)}", lambda r, v: f'integrity="{v}"'),
    ("identifier", False, lambda r: str(uuid.UUID(int=r.getrandbits(128), version=4)), lambda r, v: f"{r.choice(['id', 'uuid', 'request_id', 'trace', 'session'])}{r.choice(['=', ': ', ' '])}{v}"),
    ("data address", False, lambda r: _base64(r, 60, 400), lambda r, v: f"data:{r.choice(['image/png', 'font/woff2', 'image/gif'])};base64,{v}"),
    ("placeholder", False, _placeholder, lambda r, v: _assigned(r, _secret_name(r), v, True)),
    ("placeholder password", False, _placeholder, lambda r, v: _assigned(r, _password_name(r), v, True)),
    ("name as value", False, lambda r: _name(r, "_"), lambda r, v: _assigned(r, _secret_name(r), v)),
    ("call as value", False, lambda r: f"{r.choice(['get', 'load', 'read'])}_{_name(r, '_')}", lambda r, v: f"{_secret_name(r)} = {v}({r.choice(_WORDS)})"),
    ("path as value", False, _path, lambda r, v: _assigned(r, _secret_name(r), v)),
    ("address after a name", False, lambda r: f"{r.choice(_WORDS)}{r.randrange(100)}@{r.choice(_WORDS)}.example.com", lambda r, v: f"{_secret_name(r)}: {v}"),
    ("path", False, _path, lambda r, v: f"{_prose(r)} {v} {_prose(r)}"),
    ("web page", False, lambda r: f"{r.choice(_WORDS)}.test/20{r.randrange(10, 30)}/{r.randrange(1, 13)}/{_name(r, '-')}", lambda r, v: f"https://{v}"),
    ("name in code", False, _camel, lambda r, v: f"{r.choice(['new', 'return', 'import', 'var'])} {v};"),
    ("name in prose", False, lambda r: f"{_name(r)}_{r.randrange(1000)}", lambda r, v: f"{_prose(r)} {v} {_prose(r)}"),
    ("version", False, lambda r: f"{_name(r, '-')}-{r.randrange(20)}.{r.randrange(20)}.{r.randrange(100)}-beta{r.randrange(9)}", lambda r, v: f"{_prose(r)} {v}"),
    ("mail", False, lambda r: f"{r.choice(_WORDS)}.{r.choice(_WORDS)}{r.randrange(1000)}@{r.choice(_WORDS)}.example.org", lambda r, v: f"{_prose(r)} {v} {_prose(r)}"),
    ("number", False, lambda r: "-".join(str(r.randrange(10**4)).zfill(4) for _ in range(r.randint(4, 5))), lambda r, v: f"{_prose(r)} {v}"),
    ("minified name", False, lambda r: f"{_pick(r, _LOWER, 1)}.{_pick(r, _LOWER, 1)}.__{_name(r, '_')}__.{_pick(r, _ALNUM, 2, 4)}{r.randrange(10)}", lambda r, v: f"function({_pick(r, _LOWER, 1)}){{{v}()}}"),
]


def labelled_examples(candidates: Callable[[str], list[tuple[int, int]]], window: int, seed: int = 1, each: int = EACH) -> list[tuple[str, str, int, str]]:
    """(finding, before, label, form) of the candidates in `each` texts of every form; `before` is `window` characters."""
    rows = []
    for number, (form, secret, value, around) in enumerate(FORMS):
        rng = random.Random(1_000 * seed + number)
        for _ in range(each):
            held = value(rng)
            text = f"{_prose(rng)} " * rng.randrange(2) + around(rng, held)
            low = text.index(held)
            for a, b in candidates(text):
                label = int(secret and a < low + len(held) and b > low)
                rows.append((text[a:b], text[max(0, a - window) : a], label, form))
    return rows
