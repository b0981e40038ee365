import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import decontaminate as D
from weftline.llm import secrets as S
from weftline.llm.packing import Encoder, pack, tokenizer_path
from weftline.llm.substring_dedup import COVER, PERIOD, is_difference_cover, substring_dedup
from weftline.llm.wordhash import ALNUM_WORDS, WHITESPACE_WORDS, kgram, split_words

from .helpers import DOCS, clashing, rows, table


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \n\x0b\x00é日-_.", max_size=30), max_size=6))
def test_words(texts):
    for table_, pattern in ((WHITESPACE_WORDS, r"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = split_words(pa.array(texts, pa.string()), table_)
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) if table_ is ALNUM_WORDS else t for t in texts]
        assert got == [x for t in low for x in re.findall(pattern, t)]
        assert w.counts.tolist() == [len(re.findall(pattern, t)) for t in low]
        h = w.hashes()
        assert len(set(h.tolist())) == len(set(got))


def test_kgram_is_positional():
    h = np.arange(1, 60, dtype=np.uint64)
    for k in (1, 2, 5, 15, 35):
        g = kgram(h, k)
        assert len(g) == len(h) - k + 1 and len(set(g.tolist())) == len(g)
        assert kgram(h[3:], k)[0] == g[3]
    assert len(kgram(h, 100)) == 0


def slow_dedup(data, window):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    toks = [pattern.findall(r[1] or "") for r in data]
    seen = collections.Counter(tuple(w[i : i + window]) for w in toks for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(data, toks, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_cover():
    assert is_difference_cover(COVER, PERIOD) and not is_difference_cover((0, 1), 21)


@pytest.mark.parametrize(("window", "period", "cover"), [(35, PERIOD, COVER), (9, 7, (1, 2, 4)), (7, 7, (1, 2, 4))])
def test_substring_dedup(spark, window, period, cover):
    data = rows()
    data += [data[0], *[data[3]] * 40, *[(None, "", "en", "s", 0)] * 40]  # repeated rows
    got = substring_dedup(clashing(table(spark, data)), window=window, period=period, cover=cover).collect()
    assert sorted(map(str, got)) and sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(x[0]), *x[1:]) for x in slow_dedup(data, window))
    assert substring_dedup(table(spark, [])).count() == 0


def slow_hits(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[a : a + n])].add(i)
    out = []
    for r in docs:
        w = pattern.findall(low(r[1]))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])]
        out.append((str(r[0]), len(w), len(hit), len(found - {None}), ",".join(sorted(map(str, found - {None}))), bool(hit)))
    return out


def test_decontaminate(spark):
    data = rows(2)
    items = [(1, data[0][1]), (2, " ".join(data[3][1].split()[:12]).upper()), (3, "two words"), (4, None), (5, "..."), (2, "a a"), (None, data[6][1]), (30, data[6][1])]
    data += [(950, "x two, WORDS y", "en", "s", 0)]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    df, want = clashing(table(spark, [*data, data[0]])), slow_hits([*data, data[0]], items)
    for most in (400, 1 << 20):  # many blocks, one block
        got = D.decontaminate(df, bench, broadcast_chars=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == sorted(want)
        assert all(sum(s.words for s in r.spans) == r.n_hit for r in got)
        kept = D.without_benchmark(df, bench, broadcast_chars=most)
        assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in want if not r[-1])
        assert D.without_benchmark(df.limit(0), bench, broadcast_chars=most).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.decontaminate(table(spark, data), empty).collect())
    assert D.without_benchmark(df, empty).count() == len(data) + 1
    assert D.decontaminate(table(spark, []), bench).count() == 0


def test_benchmark_segments_hold_every_window(spark):
    """A long item is dealt in pieces; blocks stay near their size."""
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["\n", "\t", " "]) + f"w{x}" for x in rng.integers(0, 10_000, 3000))
    items = spark.createDataFrame([(1, text), (1, text), (2, "\n".join("ab" for _ in range(500)))], "item_id long, text string")
    blocks = list(D._blocks(items, "item_id", "text", 10, 5, 3000))
    assert len(blocks) > 5 and max(len(b.data) for b in blocks) < 6000
    whole = D.make_block([("1", text), ("2", "ab " * 500)])
    assert {x for b in blocks for x in b.by_size[10].keys.tolist()} == set(whole.by_size[10].keys.tolist())


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(1, 1 << 60, 10).astype(np.uint64)
        keep = []
        for _ in range(2):
            x = np.concatenate([rng.integers(1, 1 << 60, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(1, 1 << 60, rng.integers(0, 30)).astype(np.uint64)])
            g = kgram(x, 5)
            keep.append(set(g[D.winnow(g, 6)].tolist()))
        assert keep[0] & keep[1] & set(kgram(shared, 5).tolist())


ASSIGN = re.compile(r'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)')


def slow_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)  # by start, then kind


PIECES = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "\n", "é", "日", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "abcdef", "abc", "x" * 7, "-", ".", "tok", "en", "AK"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=8))
def test_automaton_equals_regex(texts):
    scanner = S.Scanner(S.RULES, test_automaton_equals_regex.dfa)
    got = scanner.spans(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [(s, k, e) for s, e, k in got.get(i, []) if k < 3] == slow_spans(t)


test_automaton_equals_regex.dfa = S.compile_rules()


def test_lanes_equal_one_pass():
    dfa = test_automaton_equals_regex.dfa
    rng = np.random.default_rng(5)
    data = np.frombuffer("".join(rng.choice(PIECES, 400)).encode() + b"f" * 3000, np.uint8)
    state, slow = 0, []
    for b in data:
        state = dfa.move[state + dfa.byte_class[b]]
        slow.append(dfa.accepts[state // dfa.classes])
    for width in (1, 7, 64, 10_000):
        assert S.run_automaton(dfa, data, width).tolist() == slow


def test_own_automata_equal_regex():
    """The rules beside the base kinds, against Python's regexes of the same patterns."""
    rng, pieces = np.random.default_rng(7), [*PIECES, "ghp_", "xoxb-", "AIza", "eyJ", "Ab3_-" * 8, "a1B2c3D4e5F6" * 3, ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "EC PRIVATE KEY-----", "ghp_" + "a1B2c3D4e5F6" * 3, "xoxb-12345-67890", "AIza" + "Ab3_-" * 7, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0", "-----BEGIN PRIVATE KEY-----"]
    scanner = S.Scanner(S.RULES, test_automaton_equals_regex.dfa)
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(1500)]
    got = scanner.spans(pa.array(texts, pa.string()))
    seen = collections.Counter()
    for i, t in enumerate(texts):
        for k, rule in enumerate(S.RULES[:-1]):
            want = [m.span() for m in re.finditer(rule.pattern, t) if re.fullmatch(rule.kept, m[0])]
            assert [(s, e) for s, e, x in got.get(i, []) if x == k] == want
            seen[rule.kind] += len(want)
        pem = [m.start() for m in re.finditer(S.RULES[-1].pattern, t)]
        assert [s for s, _, x in got.get(i, []) if x == len(S.RULES) - 1] == pem
        seen["pem"] += len(pem)
        assert got.get(i, []) == sorted(got.get(i, []), key=lambda x: (x[0], x[2]))
    assert all(seen[r.kind] for r in S.RULES)


def test_private_keys_are_covered():
    body = "\n".join(["MIIEpAIBAAKCAQEA7" + "x" * 47] * 3)
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN PRIVATE KEY-----\n{body}"
    got = S.Scanner(S.RULES, test_automaton_equals_regex.dfa).spans(pa.array([f"é {key} after", f"{cut}\nand so on", "-----BEGIN PRIVATE KEY-----  is how it begins"]))
    pem = {d: [(s, e) for s, e, k in x if S.RULES[k].kind == "pem"] for d, x in got.items()}
    assert pem == {0: [(2, 2 + len(key))], 1: [(0, len(cut))], 2: [(0, 27)]}


@pytest.mark.parametrize("text", ["password = hunter2xyz and 0123456789abcdef01234567\n" * 80_000, "token=abcdefg0 " * 260_000, "eyJ" * 1_300_000, "-----BEGIN PRIVATE KEY-----\n" * 150_000, "token  " * 600_000, "f" * 4_000_000])
def test_secrets_of_long_texts_take_linear_time(text):
    scanner = S.Scanner(S.RULES, test_automaton_equals_regex.dfa)
    began = time.perf_counter()
    scanner.spans(pa.array([text]))
    assert time.perf_counter() - began < 10


def test_secret_rows(spark):
    data = [(1, 'Password : "hunter22x" é', "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (1, "ghp_" + "a" * 40, "", "", 0), (4, "f" * 100_000, "", "", 0)]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in S.scan_secrets(clashing(table(spark, data))).collect()}
    assert got == {(1, (("assign", 0, 21),)), (2, ()), (3, ()), (1, (("github", 0, 44), ("hex", 4, 44))), (4, (("hex", 0, 100_000),))}
    kept = {r.doc_id: r.text for r in S.secret_stage(spark, clashing(table(spark, data[:3])), "").collect()}
    assert kept == {1: "*" * 21 + '" é', 2: None, 3: ""}
    assert S.scan_secrets(table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet="aZT1.'-!é́̈ ß日À\n  's%ﬁK<|>", max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"])), max_size=4).map("".join), max_size=5))
def test_parts_encode_like_whole_texts(texts):
    t = test_parts_encode_like_whole_texts
    if not hasattr(t, "tools"):
        from tokenizers import Tokenizer

        t.tools = Encoder(tokenizer_path(), most=64), Tokenizer.from_file(tokenizer_path())
    encoder, whole = t.tools
    got = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("window", [8, 2048])
def test_packing_round_trip(spark, tokenizer, window):
    data = [*rows(3), (None, None, "en", "s", 0), (990, "a <|endoftext|> b<|startoftext|>", "en", "s", 0)]
    data += [data[0], (5, "another text of id five", "en", "s", 0)]  # a repeated row and a repeated id
    df = clashing(table(spark, data).repartition(5))
    got = pack(df, window=window, open_windows=3).collect()
    by, seq = collections.Counter(), collections.defaultdict(list)
    for r in got:
        by[(r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32)] += 1
        seq[r.sequence_id].append(r)
    texts = collections.defaultdict(list)
    for i, text, *_ in data:
        texts[i].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    total = collections.Counter()
    for (i, n, start, length, crc), times in by.items():
        fits = [ids for ids in texts[i] if len(ids) == n and zlib.crc32(ids[start : start + length].tobytes()) == crc]
        assert len(fits) >= times
        total[(i, n)] += length * times
    assert total == sum((collections.Counter({(i, len(ids)): len(ids)}) for i, found in texts.items() for ids in found), collections.Counter())
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or not at & (at - 1))
    assert pack(spark.createDataFrame([], DOCS), window=window).count() == 0
