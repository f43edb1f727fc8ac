"""Packing, conversation tries and fill-in-the-middle against brute force and the tokenizer itself."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isotherm.llm import op11_pack, op12_trie, op13_fim, queries, shared

from .fixtures import SCHEMA, documents, frame, prose

# --- op11


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return op11_pack.Encoder(op11_pack.load(queries.tokenizer_path()), most=50)


ODD = [" don't WE'LL 'S''s", "<|endoftext|> x<|startoftext|>", "İstanbul ıI ΣΑΣ ς", "é é ﬁ ½ ² ª º", "a\u0085b c d　e", "中文字 ١٢٣ 12345 x_y__z", "“curly” — dash…", "\x1c\x1d a\x1fb", "a\tb\r\n\x0b\x0c c", "ǅ ß ẞ ŉ", "🙂🙂 ok", " ́x", "'", "''s '''re"]


@pytest.mark.parametrize("text", ODD)
def test_pretokens_stand_for_themselves(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n's'tdmrevl.A1_-"), st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_is_encoded_alike(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_pieces(pieces, table, tokenizer, window):
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, op11_pack.END] for _, t, *_ in table), key=repr)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length and p.offset + p.length <= window
    assert sorted(by) == list(range(len(by)))
    stream = []
    for k in sorted(by):
        row = sorted(by[k], key=lambda p: p.offset)
        assert [p.offset for p in row] == np.cumsum([0, *(p.length for p in row)])[:-1].tolist()  # gapless
        assert k == len(by) - 1 or sum(p.length for p in row) == window
        stream += row
    got, i = [], 0
    while i < len(stream):  # a document's pieces follow each other
        doc = [stream[i]]
        while sum(p.length for p in doc) < doc[0].doc_tokens:
            doc.append(stream[i + len(doc)])
        assert {(p.doc_id, p.doc_tokens) for p in doc} == {(doc[0].doc_id, doc[0].doc_tokens)}
        assert [p.start for p in doc] == np.cumsum([0, *(p.length for p in doc)])[:-1].tolist()
        got.append((doc[0].doc_id, [x for p in doc for x in p.ids]))
        i += len(doc)
    assert sorted((ids for _, ids in got), key=repr) == want
    assert sorted((str(d) for d, _ in got)) == sorted(str(r[0]) for r in table)


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, tokenizer, window):
    table = documents()
    pieces = op11_pack.pack(frame(spark, table), op11_pack.load(queries.tokenizer_path()), window=window, with_ids=True)
    rows = pieces.collect()
    check_pieces(rows, table, tokenizer, window)
    seqs = {r.sequence_id: r for r in op11_pack.sequences(pieces, window, pad=7).collect()}
    for k, s in seqs.items():
        own = sorted((p for p in rows if p.sequence_id == k), key=lambda p: p.offset)
        flat = [x for p in own for x in p.ids]
        assert s.n_tokens == len(flat) and s.ids[: len(flat)] == flat and set(s.ids[len(flat) :]) <= {7}
        assert len(s.ids) == (len(flat) if len(flat) & (len(flat) - 1) == 0 else window)
        assert [tuple(b) for b in s.boundaries] == [(p.doc_id, p.start, p.offset, p.length) for p in own]


def test_packing_of_nothing(spark):
    assert op11_pack.pack(spark.createDataFrame([], SCHEMA), op11_pack.load(queries.tokenizer_path())).collect() == []


def test_places_don_t_need_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op11_pack, "MAX_PARTS", 0)
    out = op11_pack.pack(frame(spark), op11_pack.load(queries.tokenizer_path()), window=100)
    got = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert [r.n for r in got[:-1]] == [100] * (len(got) - 1)


# --- op12


def brute_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in by.items()}


def brute_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def talks(seed, n=120, long=0):
    rng = random.Random(seed)
    say = [(rng.choice(["user", "assistant", None]), rng.choice([prose(rng, rng.randint(0, 6)), "hello there", None, ""])) for _ in range(6)]
    rows = []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 5, 8])
        for t in range(length):
            role, text = say[rng.randrange(2 if t < 2 else 6)]
            rows.append((c if rng.random() > 0.01 else None, t if rng.random() > 0.05 else None, role, text))
    same = [("user", f"turn {k % 3}") for k in range(6)]
    rows += [(c, t, *x) for c in range(1000, 1030) for t, x in enumerate(same)]  # copies
    rows += [(-25, 0, "user", "a"), (-25, 0, "user", "a"), (-25, 1, "user", "b"), (-20, 0, "user", "a")]  # ties, repeats
    rows += [(5000, t, "user", str(t % 7)) for t in range(long)]
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "long"), [(1, 0), (2, 300)])
def test_trie(spark, monkeypatch, seed, long):
    monkeypatch.setattr(op12_trie, "CHAIN", 50)
    rows = talks(seed, long=long)
    df = spark.createDataFrame(rows, TALK).withColumns({k: F.lit(1) for k in ("node", "depth", "n", "part", "total", "base")}).repartition(5)
    own = brute_turns(rows)
    assert nodes(op12_trie.prefixes(df)) == brute_trie(own)
    assert nodes(op12_trie.rebuilt_prefixes(df)) == brute_trie(brute_rebuilt(own))


def test_hot_groups_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    monkeypatch.setattr(shared, "HOT_SHARE", 10**9)
    rows = talks(3, 40)
    assert nodes(op12_trie.rebuilt_prefixes(spark.createDataFrame(rows, TALK))) == brute_trie(brute_rebuilt(brute_turns(rows)))


def test_trie_of_odd_tables(spark):
    assert op12_trie.rebuilt_prefixes(spark.createDataFrame([], TALK)).collect() == []
    assert op12_trie.prefixes(spark.createDataFrame([(None, 1, "user", "x")], TALK)).collect() == []
    gone = [(c, 0, None, None) for c in range(1, 20)]  # no base: turns before h are lost, some have none left
    out = nodes(op12_trie.rebuilt_prefixes(spark.createDataFrame(gone, TALK)))
    assert out == brute_trie(brute_rebuilt(brute_turns(gone))) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in out)


def test_ends_of_many_conversations_come_in_blocks(spark, monkeypatch):
    ids = list(range(0, 40_000, 3))
    df = spark.createDataFrame([(2, 0, i) for i in ids] + [(2, 1, 7), (3, 0, 9)], "depth long, node long, conv_id long").repartition(6)
    got = {(r.depth, r.node): r.ends_sha256 for r in op12_trie.ends_digests(df).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert got == {(2, 0): sha(ids), (2, 1): sha([7]), (3, 0): sha([9])}
    import pyarrow as pa

    monkeypatch.setattr(op12_trie, "BLOCK_CHARS", 100)
    one = pa.RecordBatch.from_arrays([pa.array([1] * 100), pa.array([5] * 100), pa.array(range(100))], ["depth", "node", "conv_id"])
    blocks = [b for f in op12_trie._blocks(iter([one.slice(0, 60), one.slice(60)])) for b in f["ids"].to_pylist()]
    assert max(map(len, blocks)) < 110 and ",".join(blocks) == ",".join(map(str, range(100)))


# --- op13


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    table = documents(n=150)
    table += [(10_000 + k, "".join(rng.choice(["<", "P", ">", "S", "M", "a", " ", "\n", "é", "🙂", "<P", "S>"]) for _ in range(rng.randint(0, 30))), None, None, None) for k in range(300)]
    want = sorted((brute_fim(r[0], r[1]) for r in table), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    df = frame(spark, table)
    made = op13_fim.transform(df)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    assert sorted((tuple(r) for r in op13_fim.restore(made).collect()), key=repr) == sorted(((r[0], r[1] or "") for r in table), key=repr)
    sha = lambda t: shared.sha(t.encode())
    digests = sorted((tuple(r) for r in op13_fim.digests(df).collect()), key=repr)
    texts = sorted(((*brute_fim(r[0], r[1])[:5], sha(brute_fim(r[0], r[1])[5]), sha(r[1] or "")) for r in table), key=repr)
    assert digests == texts
    assert op13_fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_sliced(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(op13_fim, "_SLICE", 10)
    texts = pd.Series(["x" * 25, None, "", "abc", "defgh", "y" * 9, "z"])
    parts = list(op13_fim._slices(texts, by=texts))
    assert pd.concat([p[0] for p in parts]).equals(texts) and len(parts) > 2


@given(st.text(st.sampled_from("<>PSM a\n"), max_size=30), st.integers(-5, 10**12))
def test_outputs_give_the_text_again(text, doc_id):
    _, form, _, _, out = op13_fim.transformed(doc_id, text)
    assert op13_fim.restored(out, form) == text
