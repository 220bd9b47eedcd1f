"""Labelled findings: candidates in their surroundings, each a live secret or a false positive, made from forms."""

from __future__ import annotations

import base64
import hashlib
import uuid
from random import Random

#: Common words of prose, of file names and of programs, for the coverage of a value by words.
WORDS = (
    "about account admin after all and api app application archive array back base before between bin block body book box branch build but button byte "
    "cache call can change check child class clean client code color column com config connect content copy count create data database date day debug "
    "default delete demo dev dir disk doc download email empty end error event every example field file filter find first for form format from get group "
    "guide handler has head help home host html image index info init input item java job key lang last level lib line link list load local lock log login "
    "long main make map master max message method min mode model name net new next node not null number object one open option order out page parent path "
    "port post process profile public query queue read release report request result return row run sample save schema script search server service session "
    "set setup simple size sort source start state static step store stream string style system table tag task template test text that the this thread time "
    "title total type update upload use user util value version video view web when with word work"
).split()

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_TELLING = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "DB_PASSWORD", "SECRET_KEY", "github_token", "credential", "db.password", "Password"]
_PLAIN = ["checksum", "sha1", "md5", "digest", "commit", "etag", "request_id", "id", "uuid", "version", "build", "file", "name", "order", "isbn", "key_name", "path", "revision", "trace_id", "color"]
_PROSE = ["and then we saw", "im Haus war", "le code est", "the number of", "for example in", "por la mañana", "see also", "bob@mail6.example.com wrote", "the latest contest had", "it is", "end of"]
_PATHS = ["web", "src3", "blog", "config/prod", "forum", "news/2024", None]
_TEST_PATHS = ["docs/readme", "tests/fixtures", "examples/config", "samples"]


def _of(rng: Random, letters: str, low: int, high: int) -> str:
    """A run of letters with a digit in it."""
    out = [rng.choice(letters) for _ in range(rng.randint(low, high))]
    out[rng.randrange(len(out))] = rng.choice(_DIGITS)
    return "".join(out)


def _hex(rng: Random, size: int) -> str:
    return hashlib.sha512(str(rng.random()).encode()).hexdigest()[:size]


def _mixed(rng: Random) -> str:
    return rng.choice([_hex(rng, rng.choice([16, 18, 20, 24, 32, 40, 64])), _of(rng, _LOWER + _UPPER + _DIGITS, 12, 44), _of(rng, _LOWER + _DIGITS, 12, 30), base64.b64encode(rng.randbytes(rng.choice([20, 30, 33]))).decode().rstrip("="), _of(rng, _LOWER + _UPPER + _DIGITS + "_-", 20, 48)])


def _typed(rng: Random) -> str:
    """As people choose passwords: a word with digits and signs."""
    return rng.choice(["Tr0ub4dor", "hunter", "Correct-Horse", "S3cure", "p4ssphrase", "winter"]) + "".join(rng.choice(_LOWER + _DIGITS + "!#$%") for _ in range(rng.randint(4, 9)))


def _assigned(rng: Random, name: str) -> tuple[str, str]:
    """What stands before and after a value assigned to a name."""
    quote = rng.choice(["", '"', "'"])
    return f"{rng.choice(_PROSE)} {name}{rng.choice(['=', ' = ', ': ', ':', '==', '= '])}{quote}", quote or rng.choice([" ", "\n", ", "])


def _words(rng: Random, low: int, high: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(rng.randint(low, high))]


def _secret(rng: Random) -> tuple[str, str, str]:
    kind = rng.randrange(8)
    if kind == 0:
        before, after = rng.choice([(f"{rng.choice(_PROSE)} ", " "), _assigned(rng, "aws_access_key_id"), (f"{rng.choice(_PROSE)}\n", "\n")])
        return before, rng.choice(["AKIA", "ASIA"]) + _of(rng, _UPPER + _DIGITS, 16, 16), after
    if kind == 1:
        before, after = rng.choice([(f"{rng.choice(_PROSE)} ", " "), _assigned(rng, "GH_TOKEN")])
        return before, f"gh{rng.choice('pousr')}_" + _of(rng, _LOWER + _UPPER + _DIGITS, 36, 36), after
    if kind == 2:
        return f"curl -H 'Authorization: {rng.choice(['Bearer', 'token'])} ", _mixed(rng), "'"
    if kind == 3:
        before, after = _assigned(rng, rng.choice(_TELLING))
        return before, _typed(rng), after
    before, after = _assigned(rng, rng.choice(_TELLING))
    return before, _mixed(rng), after


def _false_positive(rng: Random) -> tuple[str, str, str]:
    kind, prose = rng.randrange(10), rng.choice(_PROSE)
    if kind == 0:
        return rng.choice([f"{prose} commit ", f"{prose} ", "index ", "Merge ", "sha256:", f"{prose}\n"]), _hex(rng, rng.choice([12, 16, 18, 32, 40, 64])), rng.choice([" ", "\n", "..", ", "])
    if kind == 1:
        before, after = _assigned(rng, rng.choice(_PLAIN))
        return before, rng.choice([_hex(rng, rng.choice([32, 40])), str(uuid.UUID(bytes=rng.randbytes(16))), _of(rng, _DIGITS, 12, 18)]), after
    if kind == 2:
        return rng.choice([f"{prose} ", f"{prose}, ", f"{prose}. "]), _of(rng, _DIGITS, 12, 19), rng.choice([" ", ".", ", "])
    if kind == 3:
        return f"{prose} ", "".join(w.title() for w in _words(rng, 2, 4)) + rng.choice(_DIGITS) + rng.choice(WORDS).title(), rng.choice(["(", " ", "."])
    if kind == 4:
        return f"{prose} ", "_".join(_words(rng, 2, 4)) + f"_{rng.randint(1, 99)}_" + rng.choice(WORDS), " "
    if kind == 5:
        return rng.choice(["http://host/", "/usr/", f"{prose} "]), "/".join(_words(rng, 2, 4)) + f"-{rng.randint(1, 2030)}", rng.choice([".html", " ", "/"])
    if kind == 6:  # placeholders where secrets stand
        before, after = _assigned(rng, rng.choice(_TELLING))
        return before, rng.choice(["example", "sample", "dummy", "test", "your", "changeme", "xxxx"]) + rng.choice("-_") + "-".join(_words(rng, 1, 2)) + f"-{rng.randint(1, 12345)}", after
    if kind == 7:
        before, after = _assigned(rng, rng.choice(["test_token", "example-key", "dummy_password", "sample.secret"]))
        return before, _mixed(rng), after
    if kind == 8:
        return f"{prose} ", rng.choice([f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}-2{rng.randint(0, 9)}", f"release-{rng.randint(1, 20)}-{rng.randint(0, 99)}-build{rng.randint(1, 999)}", f"MAX_{rng.choice(WORDS).upper()}_SIZE_{rng.choice([64, 128, 1024])}", f"SN{_of(rng, _UPPER + _DIGITS, 10, 14)}"]), " "
    return rng.choice(["data:image/png;base64,", "integrity sha512-"]), base64.b64encode(rng.randbytes(rng.choice([48, 64, 90]))).decode().rstrip("="), rng.choice(['"', " "])


def findings(count: int = 1200, seed: int = 0) -> list[tuple[str, str, str, str | None, bool]]:
    """(value, before, after, path, live) of ``count`` findings, live ones and false positives in turn."""
    rng, out = Random(seed), []
    for k in range(count):
        before, value, after = (_secret if k % 2 == 0 else _false_positive)(rng)
        paths = _PATHS if k % 2 == 0 or rng.random() < 0.7 else _TEST_PATHS
        out.append((value, before[-40:], after, rng.choice(paths), k % 2 == 0))
    return out
