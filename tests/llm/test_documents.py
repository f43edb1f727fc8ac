"""Operators on documents against brute force, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from isotherm.llm import op3_substring, op4_decontaminate, op5_bpe, op6_quality, op7_simhash, queries, shared

from .fixtures import SCHEMA, documents, frame, prose, rows

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def test_word_splits():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aZé0 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 -_'\x00\x7f") for _ in range(60))
        assert [w.decode() for w in shared.alnum_words(t)] == ALNUM.findall(lower(t))
        assert [w.decode() for w in shared.space_words(t)] == SPACE.findall(t)


# --- op3


def test_window_hashes_against_their_formula():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for k in (1, 2, 6, 13, 40, 41):
        want = [sum(int(x) * pow(7, k - 1 - j, 1 << 64) for j, x in enumerate(h[s : s + k].tolist())) % (1 << 64) for s in range(len(h) - k + 1)]
        assert op3_substring.polynomial(h, k, 7).tolist() == op3_substring.mix(np.array(want, np.uint64)).tolist()
    for x in (np.array([5, -3, 200]), np.array([-(1 << 63), (1 << 63) - 1, 0]), np.array([1 << 40])):
        assert (op3_substring._unpack_ids(op3_substring._pack_ids(x)) == x).all()


def test_word_hashes_depend_on_words_only():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc\x00\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 25, 32, 33, 300]))) for _ in range(600)]
    words += [b"q" * 700, b"a", b"a\x00", b"a\x00\x00", b"q" * 31, b"q" * 32, b"q" * 33]
    texts = [b"", b" \t", *(b"".join(w + rng.choice([b" ", b"\n ", b"\t\t"]) for w in words[k : k + 50]).strip() for k in range(0, len(words), 50)), b"", b"  end "]
    a, b, n = op3_substring.word_hashes(b"key", texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    by = defaultdict(set)
    for w, pair in zip([w for t in texts for w in t.split()], zip(a.tolist(), b.tolist())):
        by[w].add(pair)
    assert all(len(x) == 1 for x in by.values())
    for lane in (0, 1):
        assert len({next(iter(x))[lane] for x in by.values()}) == len(by)
    assert (op3_substring.word_hashes(b"other", texts)[0] != a).all()
    assert len(op3_substring.word_hashes(b"key", [])[0]) == len(op3_substring.word_hashes(b"key", [b"", b" \n "])[0]) == 0


def thue_morse(n, a, b):
    """Words of 2**n characters whose sums of character values times powers of an odd base are equal modulo 2**64, for n = 11 at any base."""
    bits = [k.bit_count() & 1 for k in range(1 << n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_substring_of_words_that_weak_hashes_confuse(spark):
    from .fixtures import SCHEMA as schema

    common = [f"w{k}" for k in range(12)]
    table = []
    for n in (7, 9, 11):
        one, two = thue_morse(n, "a", "b")
        assert sum(ord(x) * pow(31, k, 1 << 64) for k, x in enumerate(one)) % (1 << 64) == sum(ord(x) * pow(31, k, 1 << 64) for k, x in enumerate(two)) % (1 << 64) or n < 11
        table += [(10 * n + k, " ".join([*common[:n], w, *common]), "en", "a", 1) for k, w in enumerate((one, two))]
    out = op3_substring.dedup(spark.createDataFrame(table, schema), digest=True, block_bytes=500)
    assert rows(out.select("doc_id", "n_words", "n_removed", "kept")) == brute_substring(table)


def brute_substring(table, window=13):
    owner = {}
    for i, text, *_ in table:
        if i is None:
            continue
        w = SPACE.findall(text or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            owner[k] = min(owner.get(k, i), i)
    out = []
    for i, text, *_ in table:
        w = SPACE.findall(text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, block, bucket", [(1, 1 << 20, 1 << 20), (2, 2000, 3000), (7, 4000, 9000)])
def test_substring(spark, batches, block, bucket):
    out = op3_substring.dedup(frame(spark), batches=batches, digest=True, block_bytes=block, bucket_bytes=bucket)
    got = rows(out.select("doc_id", "n_words", "n_removed", "kept"))
    assert got == brute_substring(documents())
    assert sum(r[2] for r in got) > 100


def test_index_opens_again_and_merges(spark):
    table = [r for r in documents() if r[0] is not None]
    parts = [[r for r in table if r[0] % 5 == k or k == 4 and r[0] >= 1000] for k in range(5)]
    parts = [sorted((r[0] - 10**6 * (4 - k), *r[1:]) for r in p) for k, p in enumerate(parts)]
    want = brute_substring([r for p in parts for r in p])
    path = op3_substring.Index.create(spark, 3).path
    got, levels = [], []
    for p in parts:
        index = op3_substring.Index.open(spark, path)  # each batch in a session of its own, as it were
        out = op3_substring.dedup(frame(spark, p), batches=1, digest=True, block_bytes=3000, index=index)
        got += rows(out.select("doc_id", "n_words", "n_removed", "kept"))
        levels.append(sorted(k for k, _ in index.runs))
        for _, run in index.runs:  # one sorted row a bucket
            kept = index.read([run]).collect()
            assert len({r.bucket for r in kept}) == len(kept)
            for r in kept:
                for x in (op3_substring._u8(r.prints), op3_substring._unpack6(r.reps)):
                    assert (x[1:] > x[:-1]).all()
    assert sorted(got, key=repr) == want
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    again = op3_substring.dedup(frame(spark, [(5 * 10**6, table[20][1], None, None, 0)]), batches=1, index=op3_substring.Index.open(spark, path))
    assert all(r.n_removed == r.n_words for r in again.collect() if r.n_words >= 13)


def test_substring_texts_and_empty(spark):
    docs = frame(spark)
    out = op3_substring.clean(docs, block_bytes=5000)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == docs.count()
    want = {(i, n) for i, n, _, _ in brute_substring(documents())}
    assert len(want) > 50
    unchanged = {(r[0], r[1]) for r in documents()} & {(r[0], r[1]) for r in out.select("doc_id", "text").collect()}
    assert len(unchanged) > 10
    assert out.filter("n_chars is not null and lang is not null").count() == docs.filter("n_chars is not null and lang is not null").count()
    assert op3_substring.clean(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op3_substring.dedup(spark.createDataFrame([], SCHEMA), digest=True).collect() == []


# --- op4


def brute_benchmark(table, bench, window=13):
    wins = defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(item)
    lengths = {len(k) for k in wins}
    out = []
    for i, text, *_ in table:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                if (k := tuple(w[s : s + m])) in wins:
                    hit.update(range(s, s + m))
                    items |= wins[k]
        names = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate(spark, block_bytes):
    table, rng = documents(), random.Random(5)
    bench = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 3, 12, 13, 14, 40])] + [(10, None), (11, ""), (None, table[3][1]), (12, table[10][1]), (13, table[10][1]), (2, table[12][1]), (100, "über go")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    out = op4_decontaminate.judge(frame(spark), benchmark, block_bytes=block_bytes)
    assert rows(out) == brute_benchmark(table, bench)
    kept = op4_decontaminate.keep(frame(spark), benchmark, block_bytes=block_bytes)
    assert kept.count() == sum(not r[5] for r in brute_benchmark(table, bench)) and kept.columns == frame(spark).columns
    assert op4_decontaminate.judge(spark.createDataFrame([], SCHEMA), benchmark, block_bytes=block_bytes).collect() == []
    assert not any(r[2] for r in rows(op4_decontaminate.judge(frame(spark), benchmark.limit(0), block_bytes=block_bytes)))


def test_wu_manber_finds_all_places():
    rng = random.Random(6)
    for m in (1, 2, 3, 5, 13):
        words = [rng.choice([b"a", b"b"]) for _ in range(400)]
        patterns = {tuple(rng.choice([b"a", b"b"]) for _ in range(m)): {k} for k in range(6)} | {tuple(words[7 : 7 + m]): {9}}
        number = {b"a": 0, b"b": 1}
        flat = np.array([number[w] for p in patterns for w in p], np.int32)
        owners = np.array([k for of in patterns.values() for k in of])
        search = op4_decontaminate.WuManber(np.concatenate((flat, flat)), np.arange(2 * len(patterns)) * m, np.concatenate((owners, owners + 100)), m)
        found = {s: set(of.tolist()) for s, of in search.search(np.array([number.get(w, -1) for w in words], np.int64))}
        own = {tuple(p): {*of, *(k + 100 for k in of)} for p, of in patterns.items()}
        assert found == {s: own[p] for s in range(len(words) - m + 1) if (p := tuple(words[s : s + m])) in own}


def test_index_stays_within_its_bound():
    """Bytes a window, with as many different words as there can be and with few: what BLOCK_WINDOWS is chosen by."""
    import pickle
    import tracemalloc

    rng = np.random.default_rng(3)
    for n_words in (500, 60_000):
        rows_ = [(f"i{k}", " ".join(f"word{x}" for x in rng.integers(0, n_words, 1000))) for k in range(60)]
        tracemalloc.start()
        index = op4_decontaminate.Index(rows_)
        held, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        windows = 60 * (1000 - 12)
        assert sum(len(s.starts) for s in index.searches) == windows
        assert held < 200 * windows and peak < 500 * windows and len(pickle.dumps(index)) < 100 * windows


def test_items_of_very_many_windows_are_cut(spark):
    rng = random.Random(12)
    long = prose(rng, 400)
    bench = [("long", long), ("long", long), ("short", prose(rng, 5)), ("other", prose(rng, 60))]
    table = [(k, prose(rng, 20) + " " + " ".join(long.split()[k * 9 : k * 9 + 30]), None, None, 0) for k in range(40)] + [(50, bench[3][1], None, None, 0)]
    benchmark = spark.createDataFrame(bench, "item_id string, text string")
    blocks = {r.block: r.n for r in op4_decontaminate._dealt(benchmark, 13, 40, 1 << 20).groupBy("block").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).collect()}
    assert len(blocks) > 8 and max(blocks.values()) <= 41
    assert rows(op4_decontaminate.judge(frame(spark, table), benchmark, block_windows=40)) == brute_benchmark(table, bench)


# --- op5


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def test_perfect_hash(vocabulary):
    assert sorted(map(vocabulary.hash.slot, vocabulary.ranks)) == list(range(len(vocabulary.ranks)))
    assert vocabulary.whole(b"no such entry here") == -1
    assert op5_bpe.PerfectHash([b"x"]).slot(b"x") == 0


def test_bpe_is_tiktoken(spark, vocabulary):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    table = documents() + [(2000, "<|endoftext|> 'S 's  \t　x²½ ١٢ 🙂🙂 ​ é" + "a" * 3000 + " \n" * 50, None, None, 0)]
    want = []
    for i, t, *_ in table:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    df = frame(spark, table)
    assert rows(op5_bpe.digests(df, vocabulary)) == sorted(want, key=repr)
    back = op5_bpe.decode(op5_bpe.encode(df, vocabulary), vocabulary)
    assert sorted((r[0] or -1, bytes(r[1])) for r in back.collect()) == sorted((i or -1, (t or "").encode()) for i, t, *_ in table)
    assert op5_bpe.digests(spark.createDataFrame([], SCHEMA), vocabulary).collect() == []


def test_memo_forgets(vocabulary):
    memo = op5_bpe.Memo(vocabulary, most=3)
    assert [memo[w] for w in ("ab", "cd", "ef", "gh", "ab", "zz")] == [op5_bpe.Memo(vocabulary)[w] for w in ("ab", "cd", "ef", "gh", "ab", "zz")]
    assert len(memo) <= 3


# --- op6


def brute_quality(table, min_docs, max_share, min_left):
    def lines(t):
        return [" ".join(w) for x in (t or "").split("\n") if (w := SPACE.findall(lower(x)))]

    contents, first = defaultdict(set), {}
    sizes = defaultdict(set)
    for i, t, _, host, _ in table:
        sizes[host].add((i, t or ""))
        for x in set(lines(t)):
            contents[host, x].add((i, t or ""))
            if i is not None:
                first[host, x] = min(first.get((host, x), i), i)
    hot = {k for k, v in contents.items() if len(v) > min_docs and len(v) > max_share * len(sizes[k[0]])}
    out = []
    for i, t, _, host, _ in table:
        w = SPACE.findall(t or "")
        wins = list(zip(w, w[1:], w[2:]))
        count = Counter(wins)
        rep = {k for s, x in enumerate(wins) if count[x] > 1 for k in (s, s + 1, s + 2)}
        raw = [x for x in (t or "").split("\n") if SPACE.search(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        gone = sum(len(x.split(" ")) for x in lines(t) if (host, x) in hot and first.get((host, x)) != i)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(raw) - len(set(raw)), len(rep), failed, gone, not failed and len(w) - gone >= min_left * len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_quality(spark, broadcast):
    table = documents()
    for min_docs, share, left in ((2, 0.05, 0.8), (1, 0.1, 0.3), (50, 0.1, 0.3), (2, 0.0, 0.5)):
        out = op6_quality.judge(frame(spark, table), min_docs=min_docs, max_share=share, min_left=left, broadcast_lines=broadcast)
        assert rows(out) == brute_quality(table, min_docs, share, left)
    kept = op6_quality.keep(frame(spark, table), broadcast_lines=broadcast)
    assert kept.columns == frame(spark, table).columns
    assert op6_quality.judge(spark.createDataFrame([], SCHEMA), broadcast_lines=broadcast).collect() == []


def test_quality_rejects_documents_of_a_table(spark):
    """On a whole table of the driver, as brute force says; this table has depleted documents at a stricter share only."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    table = [tuple(r) for r in df.collect()]
    got = rows(op6_quality.judge(df, min_left=0.7))
    assert got == brute_quality(table, op6_quality.MIN_DOCS, op6_quality.MAX_SHARE, 0.7)
    assert any(not r[6] and not r[8] for r in got) and sum(r[7] > 0 for r in got) > 1000


def test_quality_removes_and_rejects(spark):
    head = "Subscribe to our newsletter and follow us on every network that there is today"
    body = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    table = [(k, f"{head}\n{body(k, 60)}", "en", "h", 0) for k in range(20)] + [(30, "\n".join([head] * 6 + ["only this left"]), "en", "h", 0)]
    for broadcast in (1000, 0):
        out = {r.doc_id: r for r in op6_quality.judge(frame(spark, table), min_docs=5, broadcast_lines=broadcast).collect()}
        assert all(out[k].kept for k in range(20))
        assert out[0].removed_words == 0 and out[1].removed_words == 14  # the first document keeps its line
        assert not out[30].kept and out[30].n_dup_lines == 5


@pytest.mark.parametrize(("broadcast", "hot"), [(1000, None), (0, None), (0, 3)])
def test_quality_of_rows_that_share_an_id(spark, broadcast, hot):
    """Null ids, one id with several texts, one id and text under two hosts, repeated rows: alike on both paths."""
    head = "a line that very many of the documents of this host have"
    body = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    table = [(k, f"{head}\n{body(k, 60)}", "en", "h", 0) for k in range(1, 12)]
    many = "\n".join([head] * 20 + [body(99, 5)])
    table += [(None, many, "en", "h", 0), (None, f"{head}\n{body(50, 60)}", "en", "h", 0), (None, many, "en", "h", 0)]
    table += [(5, many, "en", "h", 0), (5, body(51, 70), "en", "h", 0), (5, many, "en", "other", 0), (5, many, "en", None, 0), (6, table[5][1], "en", "h", 0)]
    table += [(200 + k, f"{head}\n{body(200 + k, 60)}", "en", None, 0) for k in range(8)]
    for rows_ in (table, documents()):
        for min_docs, share, left in ((2, 0.05, 0.8), (1, 0.1, 0.3)):
            df, want = frame(spark, rows_), brute_quality(rows_, min_docs, share, left)
            options = {"min_docs": min_docs, "max_share": share, "min_left": left, "broadcast_lines": broadcast, "hot_docs": hot}
            assert rows(op6_quality.judge(df, **options)) == want
            assert Counter(r.doc_id for r in op6_quality.keep(df, **options).collect()) == Counter(w[0] for w in want if w[8])


# --- op7


def brute_simhash(table):
    fps = []
    for i, t, *_ in table:
        w = SPACE.findall(lower(t))
        sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return fps


def components_of(ids, fps, bits=3):
    n, root = len(ids), list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = {}
    for k in range(n):
        if ids[k] is not None:
            low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return [low.get(find(k)) for k in range(n)], [find(k) for k in range(n)]


def test_simhash(spark):
    table, rng = documents(), random.Random(9)
    base = prose(rng, 400).split()
    for k in range(25):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        table.append((3000 + k, " ".join(w), None, None, 0))
    fps = brute_simhash(table)
    low, roots = components_of([r[0] for r in table], fps)
    want = sorted(((i, f"{f:016x}", c) for (i, *_), f, c in zip(table, fps, low)), key=repr)
    assert rows(op7_simhash.near_duplicates(frame(spark, table))) == want
    kept = op7_simhash.keep(frame(spark, table))
    assert kept.columns == frame(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(c for c, _ in set(zip(low, roots)))
    assert op7_simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op7_simhash.keep(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_keeps_one_of_repeated_and_null_ids(spark):
    rng = random.Random(12)
    table = []
    for of in (1, None):  # a group whose smallest id is that of several texts, and one of null ids only
        base = prose(rng, 400).split()
        table += [(of, " ".join([*base[:k], "changed", *base[k + 1 :]]), None, None, 0) for k in range(0, 400, 40)]
    table += [(7, table[0][1], None, None, 0), (1, prose(rng, 400), None, None, 0)]
    fps = brute_simhash(table)
    low, roots = components_of([r[0] for r in table], fps)
    groups = Counter(zip(low, roots))
    assert any(len({f for f, i, r in zip(fps, low, roots) if (i, r) == g}) > 1 for g in groups if g[0] is None)
    assert len({f for r, f, i in zip(table, fps, roots) if r[0] == 1 and i == roots[0]}) > 1
    kept = op7_simhash.keep(frame(spark, table)).collect()
    of = {t: g for (_, t, *_), g in zip(table, zip(low, roots))}
    assert Counter(of[r.text] for r in kept) == Counter(set(groups))
    assert all(r.doc_id == of[r.text][0] for r in kept)


@pytest.mark.parametrize("limit", [4096, 6])
def test_simhash_links_of_random_fingerprints(spark, limit):
    rng = random.Random(11)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(25):  # chains that wander off
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    marked = spark.createDataFrame([(k, 0, x) for k, x in enumerate(signed)], "doc_id long, content long, fp long")
    got = {r.fp: r.component_id for r in op7_simhash.components(marked, limit).collect()}
    assert [got[s] for s in signed] == components_of(list(range(len(fps))), fps)[0]


def test_long_lists_are_searched_by_flips_in_workers(spark):
    """A worker that looks at a list of more than the limit in pairs would fail here."""
    base = 0x0123456789ABCDEF
    fps = [base ^ (a << 8) ^ b for a in range(40) for b in range(40)]  # one list of three bytes, and of five
    marked = spark.createDataFrame([(k, 0, x) for k, x in enumerate(fps)], "doc_id long, content long, fp long")

    def seen(batches):
        whole = op7_simhash.links
        op7_simhash.links = None  # in this worker, for this task
        try:
            yield from op7_simhash._forests(100, batches)
        finally:
            op7_simhash.links = whole

    rows_ = marked.select(F.lit(1).cast("short").alias("at"), F.lit(5).cast("long").alias("bytes"), "fp").coalesce(1)
    got = rows_.mapInArrow(seen, "a long, b long").collect()
    assert {r.b for r in got} == set(fps) - {min(fps)} and {r.a for r in got} == {min(fps)}
    assert {r.component_id for r in op7_simhash.components(marked, 100).collect()} == {0}


def test_hub_of_a_large_component_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_LEAST", 5)
    monkeypatch.setattr(shared, "HOT_SHARE", 50)
    links = [(0, k) for k in range(1, 200)] + [(200 + k, 201 + k) for k in range(30)] + [(7, 300), (300, 301)]
    with shared.Scratch(spark) as scratch:
        got = {r.node: r.root for r in op7_simhash.stars(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = {k: 0 for k in [*range(1, 200), 300, 301]} | {k: 200 for k in range(201, 231)}
    assert got == want


def test_both_sides_of_every_size_switch(spark):
    """What is done another way beyond a size gives the same rows there."""
    from isotherm.llm import op8_warc, op9_urls

    df, bench = frame(spark), spark.createDataFrame([(k, r[1]) for k, r in enumerate(documents(4)[:9])], "item_id long, text string")
    urls = spark.createDataFrame([(k, f"http://h{k % 7}.org/{'ab'[k % 2]}") for k in range(60)], "page_id long, url string")
    rules = spark.createDataFrame([("h1.org/a", "block"), ("org/b", "allow"), ("h2.org/", "block"), ("1.org/ab", "allow")], "key string, verdict string")
    hosts = spark.createDataFrame([("h3.org",), ("org",)], "key string")
    kind = "record_id long, type string, url string, time long, headers map<string,string>, payload string"
    records = spark.createDataFrame([(k, "revisit" if k % 3 else "response", f"http://h{k % 5 // 2}.org/", k // 4, None, str(k)) for k in range(200)], kind)
    for near, far in (
        (lambda: op4_decontaminate.judge(df, bench), lambda: op4_decontaminate.judge(df, bench, block_bytes=300)),
        (lambda: op6_quality.judge(df, min_docs=1), lambda: op6_quality.judge(df, min_docs=1, broadcast_lines=0)),
        (lambda: op7_simhash.near_duplicates(df), lambda: op7_simhash.near_duplicates(df, hot_rows=1)),
        (lambda: op8_warc.resolve(records), lambda: op8_warc.resolve(records, slice_rows=3)),
        (lambda: op9_urls.judge(urls, rules, hosts), lambda: op9_urls.judge(urls, rules, hosts, max_bytes=0)),
    ):
        a = rows(near())
        assert a == rows(far()) and len(a) > 50


def test_count_filter_prunes():
    """Of the pairs that meet in a list, few are left to verify, and no link is lost."""
    import numpy as np

    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 40, 1500).astype(np.uint64) | np.uint64(7 << 40))
    fp = np.unique(np.concatenate((fp, fp[:200] ^ np.uint64(1 << 9), fp[:200] ^ np.uint64(0b1011))))
    a, b = op7_simhash.links(fp, block=100)
    want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3).tolist() if i < j}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 400
    by = fp.view(np.uint8).reshape(-1, 8)
    reach = sum(int(((by[i] == by[i + 1 :]).sum(1) >= 5).sum()) for i in range(len(fp)))
    assert reach < 0.01 * len(fp) * (len(fp) - 1) / 2


def test_flips_equal_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 24, 3000).astype(np.uint64) << np.uint64(16) | np.uint64(5 << 40))
    a, b = op7_simhash.links(fp)
    c, d = op7_simhash.links_by_flips(fp, [2, 3, 4])
    assert set(zip(a.tolist(), b.tolist())) == {(min(x), max(x)) for x in zip(c.tolist(), d.tolist())} and len(a) > 10
