"""The pipeline, stage by stage, against brute-force versions of the stages."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from isotherm.llm import op6_quality, queries

from .fixtures import SCHEMA, prose
from .test_documents import SPACE, brute_benchmark, brute_quality, brute_simhash, brute_substring, components_of, sha

pytest.importorskip("tiktoken")


def table(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ade", "elo", "ini", "ora", "ust", "Ael", "ört")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(55), text(60)]
    rows = [(k, "\n".join([text(90), *([rng.choice(passages)] if k % 3 == 0 else []), text(60)]), "en", f"s{k % 2}", 5) for k in range(30)]
    rows += [(100 + k, rows[k][1], "en", "s1", 5) for k in range(5)]  # copies
    rows += [(200 + k, rows[k][1].replace(rows[k][1].split()[40], "changed", 1), "en", "s1", 5) for k in range(5, 9)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "too short", "en", "s0", 9), (303, text(10) + " same words here" * 60, "en", "s0", 1)]
    rows += [(400, text(70) + " " + passages[0] + " BENCH " + text(2), "en", "s0", 1)]
    bench = [(1, " ".join(rows[11][1].split()[:40])), (2, text(30)), (3, " ".join(rows[20][1].split()[30:50]))]
    return rows, bench


def test_pipeline(spark, tmp_path):
    import tiktoken

    rows, bench = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in brute_quality(rows, op6_quality.MIN_DOCS, op6_quality.MAX_SHARE, op6_quality.MIN_LEFT) if r[8]}
    now = [r for r in rows if r[0] in kept]
    assert 0 < len(now) < len(rows)
    comp, _ = components_of([r[0] for r in now], brute_simhash(now))
    now = [r for r, c in zip(now, comp) if r[0] == c]
    assert len(now) < len(kept)
    cut = {i: (n, gone) for i, n, gone, _ in brute_substring(now)}
    owner, after = {}, []
    for i, text, *rest in sorted(now):
        w = SPACE.findall(text)
        out = set()
        for s in range(len(w) - 12):
            if owner.setdefault(tuple(w[s : s + 13]), i) < i:
                out.update(range(s, s + 13))
        assert cut[i] == (len(w), len(out))
        after.append((i, " ".join(x for k, x in enumerate(w) if k not in out) if out else text, *rest))
    assert any(a[1] != b[1] for a, b in zip(after, sorted(now)))
    bad = {r[0] for r in brute_benchmark(after, bench) if r[5]}
    assert bad
    v = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    want = {i: (enc.encode_ordinary(t), sha(t)) for i, t, *_ in after if i not in bad}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None, None, None, None, None), (1, prose(random.Random(1), 90), "en", None, 3)], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes, name
            out.collect()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_entry_has_them_all():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)
