"""Recall on planted secrets: letters only, private keys of several lines, keys on other lines, repeated and long keys."""

import random
import string

import pytest

from weft.llm import secrets

PROSE = "The service reads its settings when it starts and writes a short note to the log after every request that it has answered. "
BASE64 = string.ascii_letters + string.digits + "+/"
LETTERS = string.ascii_letters


@pytest.fixture(scope="module")
def found():
    scan = secrets.Scanner(secrets.dictionary(["getUserAccountName", "configuration_manager_path"])).scan
    return lambda t: [t[s:e] for s, e, k in scan(t) if k == "novel"]


def recall(found, plant, alphabet, length, n=200):
    pick = random.Random(length)
    keys = ["".join(pick.choices(alphabet, k=length)) for _ in range(n)]
    return sum(key in found(PROSE * 2 + plant.format(key) + PROSE * 2) for key in keys) / n


@pytest.mark.parametrize(
    ("plant", "alphabet", "length", "least"),
    [
        ("Authorization: Bearer {}\n", LETTERS, 40, 0.95),
        ("Authorization: Bearer {}\n", LETTERS, 24, 0.9),
        ("the key is {} and ", BASE64, 40, 0.95),
        ("credentials:\n  {}\n", BASE64, 40, 0.95),
        ("{} is the private part\n", BASE64, 40, 0.95),
        ("signature {}\n", BASE64, 2000, 0.95),
    ],
)
def test_recall(found, plant, alphabet, length, least):
    assert recall(found, plant, alphabet, length) >= least


def test_private_keys(found):
    pick, hit, total = random.Random(3), 0, 0
    for end in ("\n", "\r\n", "\\n"):
        for _ in range(10):
            lines = ["".join(pick.choices(BASE64, k=64)) for _ in range(26)]
            got = "".join(found(PROSE + "-----BEGIN PRIVATE KEY-----" + end + end.join(lines) + end + "-----END PRIVATE KEY-----" + end + PROSE))
            hit, total = hit + sum(x in got for x in lines), total + len(lines)
    assert hit >= 0.95 * total


def test_repeated_keys(found):
    pick, hit = random.Random(4), 0
    for _ in range(100):
        key = "".join(pick.choices(BASE64, k=40))
        hit += found(f"{PROSE}auth: {key}\nsome words\nbackup credential: {key}\n{PROSE}") == [key, key]
    assert hit >= 95


def test_names_are_no_secrets(found):
    parts = "user account manager service handler request session database pool factory provider filter payment customer render".split()
    pick, hit = random.Random(5), 0
    for _ in range(200):
        hit += bool(found(f"{PROSE * 2}the key {'_'.join(pick.sample(parts, 4))} is set. {PROSE * 2}"))
    assert hit <= 20
