import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.functions.address import address_slots
from weftline.functions.phonetic import skeleton, sounds, transliterate, transliterate_text
from weftline.functions.tokens import NAME_NOISE, is_abbreviation, legal_match, strip_tail, without
from weftline.functions.unicode import fold, fold_marks, fold_marks_text, fold_text


def values(spark, rows, column, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_fold(spark):
    rows = [("Société Générale S.A.R.L.",), ("A & B",), ("plain  Text_x",), (None,), ("s.a.r.l. x.y",), ("Straße ﬁn",), ("ACME, Inc.",)]
    assert values(spark, rows, fold(F.col("s")), "s string") == ["societe generale sarl", "a and b", "plain text x", "", "sarl x y", "strasse fin", "acme inc"]
    assert values(spark, [("O'Brien + Söhne",), ("a`b",)], fold_marks(F.col("s")), "s string") == ["obrien and sohne", "ab"]


def test_fold_paths_agree(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("aB .&-_,'9\t") for _ in range(rng.randint(0, 20))),) for _ in range(300)]
    anything = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x300, 0x310), *range(0x2010, 0x2060)]]
    rows += [("".join(rng.choice(anything if i % 2 else "aB. &'’ßéÄüñÖ-_,S.A.") for _ in range(rng.randint(0, 14))),) for i in range(3000)]
    assert values(spark, rows, fold(F.col("s")), "s string") == [fold_text(r[0]) for r in rows]
    assert values(spark, rows, fold_marks(F.col("s")), "s string") == [fold_marks_text(r[0]) for r in rows]


def test_fold_is_idempotent():
    for s in ("Société S.A.", "x & y", "É_1"):
        assert fold_text(fold_text(s)) == fold_text(s)


def test_abbreviations(spark):
    rows = [("blvd", "boulevard"), ("llc", "limitedliabilitycompany"), ("rd", "street"), ("12", "123"), ("rd", "rd"), ("a.", "abc")]
    assert values(spark, rows, is_abbreviation(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, False, False, False]


def test_legal_match(spark):
    rows = [(["llc"], ["limited", "liability", "company"]), (["sas"], ["societe", "par", "actions", "simplifiee"]), ([], ["ltd"]), (["a", "b"], ["b", "a"]), (["a", "b"], ["b"])]
    assert values(spark, rows, legal_match(F.col("a"), F.col("b")), "a array<string>, b array<string>") == [0.9, 0.9, -1.0, 1.0, 0.5]


def test_strip_tail_keeps_a_name(spark):
    rows = [(["acme", "foods", "private", "limited"],), (["limited"],), ([],)]
    assert values(spark, rows, strip_tail(F.col("t"), ["private", "limited"]), "t array<string>") == [["acme", "foods"], ["limited"], []]
    assert values(spark, [(["the", "x", "x"],)], without(F.col("t"), NAME_NOISE), "t array<string>") == [["x", "x"]]


def slots(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", address_slots(F.col("s"), **options).alias("x")).collect()
    return [r.x.asDict() for r in sorted(rows)]


def test_addresses(spark):
    empty = {"house": "", "postcode": "", "numbers": [], "street": [], "tail": [], "tokens": [], "landmark": False, "landmark_tokens": []}
    got = slots(spark, ["Near Metro Pillar 42 33 Stonebridge Road, Indore, 653200", "23/33 Ravenwood Drive, Fresno", None, "", ",,;", "12 - 4b rue É'tage; 75001 Paris", "Opp Bank", "nearby 5", "5 A Rd 6 B St C"], expand={"rd": "road"})
    a = got[0]
    assert (a["house"], a["postcode"], a["landmark"], a["landmark_tokens"]) == ("33", "653200", True, ["near", "metro", "pillar", "42"])
    assert (a["street"], a["tail"], a["numbers"]) == (["stonebridge", "road"], ["indore"], ["33", "653200"])
    a = got[1]
    assert (a["house"], a["numbers"], a["street"], a["tail"]) == ("23/33", ["23", "23/33", "33"], ["ravenwood", "drive"], ["fresno"])
    assert got[2] == got[3] == got[4] == empty
    assert (got[5]["house"], got[5]["postcode"], got[5]["street"], got[5]["numbers"]) == ("12-4b", "75001", ["rue", "e", "tage"], ["12", "12-4b", "4b", "75001"])
    assert got[6] == empty | {"landmark": True, "landmark_tokens": ["opp", "bank"]}
    assert not got[7]["landmark"] and got[7]["house"] == "5"
    assert (got[8]["street"], got[8]["tail"], got[8]["tokens"]) == (["a", "road", "b"], ["st", "c"], ["a", "road", "b", "st", "c"])
    assert slots(spark, ["Portal 9 x"], cues=frozenset())[0]["landmark"] is False


def test_transliteration(spark):
    assert len(sounds()) > 500
    known = {"राम": "ram", "कमल": "kamal", "वेंकटेश्वर": "venkateshvar", "মহা ১২": "mah 12", "plain": "plain", "अॉ": "o"}
    assert values(spark, [(k,) for k in known], transliterate(F.col("s")), "s string") == list(known.values())
    rng = random.Random(3)
    letters = [c for c in sounds() if c < "\u0D80"] + list("abka x-1")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 10))) for _ in range(2000)]
    assert values(spark, [(t,) for t in texts], transliterate(F.col("s")), "s string") == [transliterate_text(t) for t in texts]
    assert values(spark, [("phoenix",), ("cool zoo",)], skeleton(F.col("s")), "s string") == ["fnx", "kl s"]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_kernels():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert kernels.lcs_length(a, b) == slow_lcs(a, b)
    assert kernels.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert kernels.token_set("a b", "b a c") == 1.0
    assert kernels.partial("abc", "xxabcxx") == 1.0
    assert kernels.indel("", "") == 1.0 and kernels.token_set("", "a") == 0.0
