"""The verdict on a string is the same whatever stands around it: one line, one sentence, a long text."""

import random
import string

import pytest
import zstandard

from weft.llm import secrets

PROSE = "The service reads its settings when it starts and writes a short note to the log after every request that it has answered. "
PLACES = {
    "bare": "Authorization: Bearer {}\n",
    "line": "Please store the key {} and call back.",
    "sentence": PROSE + "The credential {} is new.\n",
    "long": PROSE * 4 + "the key is {} and so on. " + PROSE * 4,
}
ALPHABETS = {
    "letters": string.ascii_letters, "alnum": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/", "hex": string.digits + "ABCDEF",
}
PARTS = """user account manager service handler request session database pool factory provider filter payment customer render abstract singleton
proxy bean generator middleware configuration repository exception listener transaction resolver template""".split()


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.dictionary(["getUserAccountName", "configuration_manager_path"]))


def novel(scanner, text):
    return [text[s:e] for s, e, k in scanner.scan(text) if k == "novel"]


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("length", [24, 32, 40, 64, 100, 127, 128, 400])
def test_recall(scanner, place, alphabet, length):
    pick = random.Random(f"{place} {alphabet} {length}")
    keys = ["".join(pick.choices(ALPHABETS[alphabet], k=length)) for _ in range(100)]
    assert sum(key in novel(scanner, PLACES[place].format(key)) for key in keys) >= 90


@pytest.mark.parametrize("place", PLACES)
def test_names(scanner, place):
    pick, hit, total = random.Random(place), 0, 0
    for k in (2, 3, 4, 5, 6):
        for _ in range(60):
            parts = pick.sample(PARTS, k)
            for name in ("_".join(parts), "".join(p.title() for p in parts), "/".join(parts) + ".py", "-".join(parts) + "-v2"):
                if len(name) >= 16:
                    hit, total = hit + bool(novel(scanner, PLACES[place].format(name))), total + 1
    assert hit < 0.05 * total


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("name", [
    "AbstractSingletonProxyFactoryBeanGenerator", "src/main/java/org/example/app/Config.java", "Bundesverfassungsgerichtsentscheidung",
    "usr/local/share/applications/settings.conf", "release-2.14.3-20240115", "my_project_2024_release_candidate_v3",
])
def test_paths_dates_and_long_words(scanner, place, name):
    assert novel(scanner, PLACES[place].format(name)) == []


def test_candidates_begin_where_words_begin(scanner):
    assert novel(scanner, "authentication-middleware-configuration-service-v2") == []
    assert novel(scanner, "see keyQ8Zr7Kp2Lx0Vt5Nw3Yb9Ce1Df6 there") == ["keyQ8Zr7Kp2Lx0Vt5Nw3Yb9Ce1Df6"]
    assert novel(scanner, "api_key_q8Zr7Kp2Lx0Vt5Nw3Yb9Ce1Df6") == ["_q8Zr7Kp2Lx0Vt5Nw3Yb9Ce1Df6"]


@pytest.mark.parametrize("length", [16, 63, 64, 65, 300])
def test_marginal_bytes_by_brute_force(scanner, length):
    """Each piece costs the size with it less the size without it, by a compressor made anew."""
    words = zstandard.ZstdCompressionDict(secrets.dictionary(["getUserAccountName", "configuration_manager_path"]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda t: len(zstandard.ZstdCompressor(level=secrets.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.encode()))
    pick = random.Random(length)
    for alphabet in ALPHABETS.values():
        key = "".join(pick.choices(alphabet, k=length))
        want = sum(size(secrets.frame() + PROSE + key[max(0, k - 64) : k + 64]) - size(secrets.frame() + PROSE + key[max(0, k - 64) : k]) for k in range(0, length, 64))
        assert abs(scanner.added(PROSE, key) - want) <= 2 * -(-length // 64)


def test_identifiers_are_chosen_by_their_share(spark):
    rows = [("alpha = 1\n" * 50 + "beta(2)\n" * 49 + "gamma: 3",), ("no names here",), (None,), ("",)]
    docs = spark.createDataFrame(rows, "text string")
    assert secrets.identifiers(docs, 2) == ["alpha"]
    assert secrets.identifiers(docs, 100) == ["alpha", "beta", "gamma"]
    assert secrets.identifiers(docs.where("false")) == []


@pytest.mark.parametrize("place", PLACES)
def test_numbers_are_no_secrets(scanner, place):
    pick = random.Random(place)
    assert sum(bool(novel(scanner, PLACES[place].format("".join(pick.choices(string.digits, k=16))))) for _ in range(200)) <= 4
