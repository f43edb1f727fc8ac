"""Operators on licences, conversations, pages and records against brute force, and on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isotherm.llm import op1_license, op2_chat, op8_warc, op9_urls, op10_html, queries, shared

from .fixtures import SCHEMA, documents, frame, prose, rows
from .test_documents import ALNUM, lower, sha

# --- op1


def brute_license(text, templates):
    w = ALNUM.findall(lower(text))
    base, base_labels, labels, best = [], set(), set(), 0.0
    for t in templates:
        own = ALNUM.findall(lower(t.text))
        keys = [ALNUM.findall(lower(key)) for key in t.keys]
        ats = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
        stands = lambda k, p: p >= 0 and w[p : p + len(k)] == k
        for start in range(-len(own), len(w)):
            if not stands(keys[0], start + ats[0]):
                continue
            drifts = [0]
            for k, at in zip(keys[1:], ats[1:]):
                near = [d for d in range(-op1_license.DRIFT, op1_license.DRIFT + 1) if stands(k, start + at + d)]
                drifts += [min(near, key=lambda d: (abs(d), d))] if near else []
            if len(drifts) < len(keys):
                continue
            follows = [drifts[max(0, sum(at <= i for at in ats) - 1)] for i in range(len(own))]
            same = sum(0 <= start + d + i < len(w) and w[start + d + i] == x for i, (d, x) in enumerate(zip(follows, own)))
            best = max(best, 0.5 if t.base else 0.5 + 0.5 * (same / len(own)))
            labels.add(t.label)
            if t.base:
                base.append(start)
                base_labels.add(t.label)
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), best


def changed(rng, text):
    """A copy of a licence text with words left out, put in and replaced here and there."""
    words = text.split()
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.randint(0, 12)] = [rng.choice(["the", "software", "holders", "(c)", "2021"]) for _ in range(rng.randint(0, 18))]
    return " ".join(words)


def test_license_scan(spark):
    rng = random.Random(21)
    pieces = [t.text for t in op1_license.TEMPLATES] + ["MIT License", "the mit  license, apache-license", "general public license", "mit", "license license mit license"]
    table = documents()
    for k in range(120):
        cut = [" ".join(p.split()[rng.randint(0, 2) : len(p.split()) - rng.randint(0, 2)]) for p in rng.sample(pieces, 3)]
        table.append((5000 + k, " ".join([prose(rng, rng.randint(0, 9)), rng.choice(cut), prose(rng, 4), *cut]).upper() if k % 2 else rng.choice(cut), None, None, 0))
    out = op1_license.scan(frame(spark, table)).drop("matches")
    want = [(i, *brute_license(t, op1_license.TEMPLATES)) for i, t, *_ in table]
    assert rows(out) == sorted(want, key=repr)
    assert {x for w in want for x in w[6].split(",")} > {"mit", "apache", "gpl", "bsd", "isc", "mit-full", "gpl-3-notice"}
    assert op1_license.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_license_index_ignores_idf_for_results():
    rng, words = random.Random(2), sorted({w for t in op1_license.TEMPLATES for w in t.words()})
    text = [rng.choice(words) for _ in range(3000)] + shared.alnum_words("gnu general public license mit license")
    first = op1_license.Index(op1_license.TEMPLATES, {}, 0).scan(text)
    for _ in range(5):
        assert op1_license.Index(op1_license.TEMPLATES, {w: rng.randint(0, 50) for w in words}, 50).scan(text) == first


def test_license_scores_say_something():
    scan = lambda t: op1_license.Index(op1_license.TEMPLATES, {}, 0).scan(shared.alnum_words(t))[4:6]
    assert scan("nothing of the kind") == ("", 0.0) and scan("see the MIT License") == ("mit", 0.5)
    labels, whole = scan("Licensed under the GNU General Public License, version 3")
    assert labels == "gpl,gpl-3" and whole == 1.0
    assert 0.5 < scan("this is free and unencumbered software, really")[1] < 1
    assert scan("may be used to endorse or promote products derived from this software")[0] == "bsd-3-clause"


def test_license_texts_that_were_changed():
    rng, index, found = random.Random(31), op1_license.Index(op1_license.TEMPLATES, {}, 0), Counter()
    for _ in range(400):
        text = " ".join([prose(rng, rng.randint(0, 5)), *(changed(rng, rng.choice(op1_license.TEXTS).text) for _ in range(rng.randint(1, 3)))])
        n_base, first, last, base_labels, labels, score, _ = index.scan(shared.alnum_words(text))
        assert (n_base, first, last, base_labels, labels, score) == brute_license(text, op1_license.TEMPLATES)[1:], text
        found.update(labels.split(","))
    assert all(found[t.label] for t in op1_license.TEXTS)


def test_license_sql(spark, tmp_path):
    rng, table = random.Random(32), [t for t in documents()]
    for k in range(150):
        table.append((9000 + k, " ".join(changed(rng, rng.choice(op1_license.TEMPLATES).text) for _ in range(rng.randint(1, 3))), None, None, 0))
    table += table[-2:]
    frame(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(queries.ORACLE_SQL["op1_license_scan"]).fetchall()
    assert rows(queries.op1_license_scan(spark, str(tmp_path))) == sorted(want, key=repr)


def labels_of(text, mark="", holder="the copyright holder"):
    """The labels of whole texts in a file that states one, each line of it behind a comment mark."""
    text = text.replace("the copyright holder", holder)
    lines = "\n".join(f"{mark}{' '.join(text.split()[i : i + 12])}" for i in range(0, len(text.split()), 12))
    found = op1_license.Index(op1_license.TEMPLATES, {}, 0).scan(shared.alnum_words(f"{mark}Copyright (c) 2024 A. Person\n{mark}\n{lines}\nint main() {{}}\n"))[4]
    return {x for x in found.split(",") if x in {t.label for t in op1_license.TEXTS}}


def test_license_texts_are_told_apart():
    text = {t.label: t.text for t in op1_license.TEXTS}
    for label in text:
        for mark in ("", "# ", " * ", "// "):
            assert labels_of(text[label], mark) == {label}
    other = "Example Foundation, Inc., its subsidiaries"
    regents = text["bsd-3-full"].replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    numbered = text["bsd-2-full"].replace("1. ", "a) ").replace("2. ", "b) ")
    assert labels_of(text["bsd-3-full"], holder=other) == labels_of(regents) == {"bsd-3-full"} and labels_of(numbered) == {"bsd-2-full"}
    assert labels_of(text["mit-full"].replace("AUTHORS OR COPYRIGHT HOLDERS", "COMPANY")) == {"mit-full"}
    assert labels_of(text["isc-full"].replace("and/or distribute", "and distribute").replace("THE AUTHOR", "EXAMPLE CORP")) == {"isc-full"}
    assert labels_of(text["gpl-3-notice"].replace("This program", "The library of examples")) == {"gpl-3-notice"}
    assert labels_of(text["apache-2.0-notice"].replace("http://www", "https://www")) == {"apache-2.0-notice"}
    # A key phrase is missing, far off, or out of order: no copy of the text.
    assert labels_of(text["mit-full"].split("THE SOFTWARE IS")[0]) == set()
    assert labels_of(text["zlib"].replace("1. The origin", "word " * 40 + "1. The origin")) == set()
    assert labels_of(" ".join(reversed(text["bsl-1.0"].split(" and ")))) == set()


def test_template_needs_its_keys():
    with pytest.raises(ValueError):
        op1_license.Template("x", "some words", ("other words",)).key_places()
    with pytest.raises(ValueError):
        op1_license.Template("x", "some other words", ("words", "some other")).key_places()


# --- op2

texts = st.lists(st.sampled_from(list("\\<>[]/INSTSYtoolrne <s></s>é\n") + ["<<SYS>>", "[/INST]", "</s>", "<role>", "</turn>"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "other", "<role>"]), texts), max_size=5))
def test_template_round_trip(turns):
    t = op2_chat.TEMPLATE
    formatted = "".join(s for r, x in turns for s, _ in t.segments(r, x))
    assert [(r, x) for r, x, _ in t.parse(formatted)] == turns
    for _, x in turns:
        assert not any(c in t.quote(x) for c in t.controls)


def test_chat(spark):
    table = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b </s>"), (1, 2, "user", None), (2, 1, "assistant", "late"), (2, 0, "system", "[INST]"),
        (3, 0, "user", ""), (3, 0, "assistant", "tie"), (3, None, "robot", "x"), (None, 0, None, "null"), (4, 0, "user", "x" * 100_000), (4, 1, "assistant", "ü" * 100_000),
        (5, 0, "user", "same"), (5, 0, "user", "same"),
    ]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "valid": F.lit(2), "turn_no": F.lit(3)})
    got = {r.conv_id: r for r in op2_chat.digests(op2_chat.segments(df)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in table:
        by[c].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, _, _, r, x in sorted(turns)]
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
        assert got[c].formatted_chars == sum(len(s) for r, x in turns for s, _ in op2_chat.TEMPLATE.segments(r, x))
    assert {c for c, r in got.items() if r.valid} == {1, 4}
    assert op2_chat.digests(op2_chat.segments(df.limit(0))).collect() == []


def test_chat_across_batches(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.when(F.floor(F.col("id") / 2) % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    out = {r.conv_id: r for r in op2_chat.digests(op2_chat.segments(df)).collect()}
    for c in (0, 1):
        said = "".join(str(i) for i in range(c, 5000, 2) if i // 2 % 2)
        assert out[c].n_turns == 2500 and out[c].valid and out[c].loss_sha256 == sha(said)


# --- op8

RECORDS = "record_id long, type string, url string, time long, headers map<string,string>, payload string"


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    table = [
        (1, "response", "HTTP://Ex.org:80/a?utm_source=x&b=2&a=1#top", 10, h(ETag='"1"', Content_Type="text/html", Date="d1"), "one"),
        (2, "revisit", "http://ex.org/a?a=1&b=2", 20, h(etag='"1"', date="d2", server="no"), None),
        (3, "response", "http://ex.org/a?a=1&b=2", 30, h(ETag='"3"', Last_Modified="m"), "three"),
        (4, "revisit", "http://ex.org/a?b=2&a=1", 40, h(ETag='"1"'), None),
        (5, "revisit", "http://ex.org/a?b=2&a=1", 30, None, None),
        (6, "revisit", "http://ex.org/a?b=2&a=1", 31, h(last_modified="m", expires="e"), None),
        (7, "revisit", None, 50, None, None),
        (8, "revisit", "http://ex.org", 5, None, None),
        (9, "response", "http://ex.org/", None, None, ""),
        (10, "revisit", "http://ex.org/", None, None, None),
        (2, "revisit", "http://ex.org/a?a=1&b=2", 20, h(etag='"1"', date="d2", server="no"), None),
        (11, "request", "http://ex.org/", 1, None, "x"),
    ]
    df = spark.createDataFrame(table, RECORDS).withColumns({"slice": F.lit(0), "response_id": F.lit(9), "stored": F.lit(1)})
    for slice_rows in (100_000, 1, 2):
        got = {r.record_id: r for r in op8_warc.resolve(df, slice_rows).collect()}
        assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {
            2: (1, "resolved"), 4: (3, "validator_mismatch"), 5: (1, "resolved"), 6: (3, "resolved"), 7: (None, "no_response"), 8: (9, "resolved"), 10: (None, "no_response"),
        }
        assert [tuple(x) for x in got[2].headers] == [("content-type", "text/html"), ("date", "d2"), ("etag", '"1"')] and got[2].payload == "one"
        assert [tuple(x) for x in got[6].headers] == [("etag", '"3"'), ("expires", "e"), ("last-modified", "m")]
        assert got[4].headers is None and got[8].headers == []
    assert op8_warc.resolve(df.limit(0)).collect() == []


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_revisits_against_brute_force(spark, slice_rows):
    rng = random.Random(slice_rows)
    table = [(k, rng.choice(["response", "revisit"]), f"http://x.org/{rng.choice('aab')}", rng.randint(0, 40), None, str(k)) for k in range(200)]
    got = {r.record_id: r.response_id for r in op8_warc.resolve(spark.createDataFrame(table, RECORDS), slice_rows).collect()}
    for k, kind, url, time, *_ in table:
        if kind == "revisit":
            earlier = [(t, i) for i, y, u, t, *_ in table if y == "response" and u == url and t < time]
            assert got[k] == max(earlier, default=(None, None))[1]


def test_warc_files(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nX: y\r\n\r\nhello\r\n\r\nWARC/1.1 in it"
    records = [{"type": "response", "id": f"<urn:{k}>", "date": "2024-01-01T00:00:00Z", "url": f"http://x.org/{k}", "fields": {"WARC-Payload-Digest": "sha1:x"}, "body": body * k} for k in range(4)]
    raw = b"".join(map(op8_warc.encode, records))
    assert [r["body"] for r in op8_warc.decode(raw)] == [body * k for k in range(4)]
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(op8_warc.encode(r)) for r in records))
    got = op8_warc.read(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {(r.id, r.url, bytes(r.body)) for r in got} == {(r["id"], r["url"], r["body"]) for r in records}
    assert op8_warc.http_parts(body) == ({"ETag": '"a"', "X": "y"}, b"hello\r\n\r\nWARC/1.1 in it")
    with pytest.raises(ValueError):
        list(op8_warc.decode(raw[:-8]))
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(raw[:-8])
    whole = b"".join(gzip.compress(op8_warc.encode(r)) for r in records)
    (cut / "b.warc.gz").write_bytes(whole[:-30])
    (cut / "c.warc.gz").write_bytes(whole[:-30] + b"x" * 20)
    (cut / "d.warc").write_bytes(b"")
    (cut / "e.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: no\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: x")
    got = defaultdict(list)
    for r in op8_warc.read(spark, str(cut)).collect():
        got[r.path[-9:].split("/")[-1]].append((r.id, r.status))
    good = [(f"<urn:{k}>", "ok") for k in range(3)]
    assert got["a.warc"] == [*good, ("<urn:3>", "cut_off")]
    for name in ("b.warc.gz", "c.warc.gz"):
        assert got[name][:3] == good and len(got[name]) == 4 and got[name][3][1] in ("cut_off", "unreadable")
    assert got["e.warc"] == [(None, "ok"), (None, "cut_off")] and "d.warc" not in got


def test_records_with_one_id_and_weak_tags(spark):
    table = [
        (1, "response", "http://x.org/", 5, {"ETag": 'W/"1"'}, "late"), (1, "response", "http://x.org/", 3, {"ETag": '"1"'}, "b"), (1, "response", "http://x.org/", 3, {"ETag": '"1"'}, "a"),
        (1, "revisit", "http://x.org/", 4, {"etag": '"1"'}, None), (1, "revisit", "http://x.org/", 9, {"etag": '"2"'}, None), (None, "revisit", "http://x.org/", 9, None, None), (None, "response", "http://x.org/", 3, None, "no"),
        (3, "response", "http://y.org/", 3, {"ETag": 'W/"1"'}, "weak"), (4, "revisit", "http://y.org/", 4, {"etag": '"1"'}, None),
    ]
    got = [op8_warc.resolve(spark.createDataFrame(t, RECORDS).repartition(2)).orderBy("record_id").collect() for t in (table, table[::-1])]
    assert got[0] == got[1]
    assert [(r.record_id, r.response_id, r.outcome) for r in got[0]] == [(1, 1, "resolved"), (4, 3, "resolved")] and got[0][0].payload in ("a", "b")


def test_a_burst_of_one_url_is_spread(spark):
    """One URL has 90 % of the records, all of them within two seconds: no partition gets many more than the rest."""
    n = 20_000
    one = spark.range(n).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "response").otherwise("revisit").alias("type"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://x.org/"), F.col("id"))).otherwise("http://hot.org/").alias("url"),
        (10**9 + F.col("id") % 2).alias("time"), F.lit(None).cast("map<string,string>").alias("headers"), F.col("id").cast("string").alias("payload"),
    )
    order = ["url", "time", F.col("is_revisit").desc(), "record_id"]
    slim = one.select("record_id", "url", "time", (F.col("type") == "revisit").alias("is_revisit"))
    sizes = [r["count"] for r in slim.repartitionByRange(20, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * n / 20
    got = {r.record_id: r.response_id for r in op8_warc.resolve(one, slice_rows=1000).collect()}
    last = max(k for k in range(0, n, 2) if k % 10)
    assert got == {k: last for k in range(1, n, 2)}


# --- op9


def brute_urls(urls, rules, listed, default="allow"):
    out = []
    for page, url in urls:
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
            host, path = lower(m[1]), m[2]
        fits = []
        for key, verdict in rules:
            rule_host, slash, rest = key.partition("/")
            if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
                fits.append((len(key), key, verdict))
        if fits:
            _, key, verdict = min(fits, key=lambda x: (-x[0], x[1]))  # the smallest of equally long ones
            out.append((page, host, path, key, verdict))
        else:
            out.append((page, host, path, None, "block" if any(host == h or host.endswith("." + h) for h in listed) else default))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_url_filter(spark, max_bytes):
    rng = random.Random(8)
    hosts = ["example.org", "a.Example.ORG", "notexample.org", "x.com", "www.x.com", "com", "org", "y.net", "b.y.net", "user@z.org:80", "", ".", "a..org"]
    ends = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/fr/a", "/de/", "?q=/es/", "#/es/", "/a://b"]
    urls = [(k, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(ends)}") for k in range(300)] + [(900, None), (901, ""), (902, "no scheme/es/"), (903, "a://b://c/de/"), (None, "http://x.com/de/"), (5, "http://x.com/de/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"key": F.lit(1), "host": F.lit("h"), "rule": F.lit(0)})
    rules = [*op9_urls.RULES, ("x.com/d", "allow"), ("com/fr/a", "block"), ("x.com/fr", "allow"), ("y.net", "block"), ("b.y.net/en/", "allow"), ("/de/", "block"), ("", "block")]
    listed = ["notexample.org", "z.org:80", "com"]
    out = op9_urls.judge(pages, spark.createDataFrame(rules, "key string, verdict string"), spark.createDataFrame([(x,) for x in [*listed, None, ""]], "key string"), max_bytes=max_bytes)
    assert rows(out) == brute_urls(urls, rules[:-2], listed)
    none = spark.createDataFrame([], "key string, verdict string")
    assert {r.verdict for r in op9_urls.judge(pages, none, none.select("key"), max_bytes=max_bytes).collect()} == {"allow"}
    assert op9_urls.judge(pages.limit(0), none, none.select("key"), max_bytes=max_bytes).collect() == []


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_url_filter_of_equally_long_rules(spark, max_bytes):
    pages = spark.createDataFrame([(1, "https://a.org/ab"), (2, "https://b.org/ab"), (3, "https://é.org/ab")], "page_id long, url string")
    rules = spark.createDataFrame([("a.org/", "allow"), ("org/ab", "block"), ("é.org/", "allow")], "key string, verdict string")
    out = op9_urls.judge(pages, rules, spark.createDataFrame([], "key string"), max_bytes=max_bytes)
    assert [(r.page_id, r.rule, r.verdict) for r in out.orderBy("page_id").collect()] == [(1, "a.org/", "allow"), (2, "org/ab", "block"), (3, "org/ab", "block")]


def test_cascade_is_exact(spark):
    keys = [f"h{k}.org/" for k in range(4000)]
    lists = [set(keys[:5]), set(keys[:300]), set(keys[:3900]), set(keys), set()]
    universe = spark.createDataFrame([(k, sum(1 << n for n, x in enumerate(lists) if k in x)) for k in keys], "key string, mask long")
    cascades = op9_urls.build_cascades(universe, len(lists))
    assert [{k for k in keys if k in c} for c in cascades] == lists
    assert len(cascades[1].levels) > 1 and not cascades[4].levels
    assert op9_urls.build_cascades(universe, len(lists), max_bytes=100) is None
    none = universe.limit(0)
    assert [c.levels for c in op9_urls.build_cascades(none, 2)] == [[], []]


# --- op10


def test_main_text_of_articles():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>
<aside>side</aside><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p><b>One&nbsp;two
 three.<br><p>4 &lt; 5 a<b>b</b>c</p><form><p>name <input></p></form><ul><li>item<li>other</ul><p>x &copy; y &am</p>
<div class="advert">ad</div><section id="comments"><p>nice!</p></section><p class="lead">End</p></article>
<footer>&copy; me</footer></body></html>"""
    want = "Title & more\nOne two three.\n4 < 5 abc\nitem\nother\nx © y &am\nEnd"
    assert op10_html.main_text(page) == want
    assert op10_html.main_text(page.replace("</article>", "").replace("</body></html>", "")) == want
    assert op10_html.main_text(page.replace("article", "main")) == want


def test_main_text_without_an_article():
    long = "word " * 40
    menu = "".join(f"<div><a href=x>Menu {k} of the whole site with many words</a></div>" for k in range(12))
    page = f"<body>{menu}<div><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p></div><div><p></p></div>{menu}"
    assert op10_html.main_text(page) == f"Head\n{long.strip()}\nshort\n{long.strip()}"


def test_main_text_of_nested_and_neighbouring_articles():
    long = " ".join(f"word{k}" for k in range(40))
    for page, want in (
        (f"<main><h1>Title</h1><article><p>{long}</p><p>end</p></article><p>after</p></main>", f"Title\n{long}\nend\nafter"),
        (f"<article><p>teaser</p></article><article><p>{long}</p><p>more</p></article>", f"{long}\nmore"),
        (f"<article><p>{long}</p></article><article>{'<p>forty characters of a block of text ..</p>' * 20}</article>", "\n".join(["forty characters of a block of text .."] * 20)),
        (f"<article><p>first</p><article><p>{long}</p></article><p>last</p></article><p>outside {long}</p>", f"first\n{long}\nlast"),
        (f"<article><p><a href=x>{long}</a></p></article><article><p>text</p></article>", "text"),
    ):
        assert op10_html.main_text(page) == want


LONG = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize("between", ["<div class=ad><p>Buy</p></div>", "<aside>side</aside>", "<form><p>name <input></p></form>", "<div class=ad>Buy</div><div class=share>us</div>"])
def test_main_text_around_left_out_elements(between):
    for page in (f"<body><div><p>{LONG}</p>{between}<p>{LONG} b</p></div>", f"<body><p>{LONG}</p>{between}<p>{LONG} b</p>", f"<body><div><p>{LONG}</p></div>{between}<div><p>{LONG} b</p></div>"):
        assert op10_html.main_text(page) == f"{LONG}\n{LONG} b"
    assert op10_html.main_text(f"<div><h1>Title</h1>{between}<p>{LONG}</p>{between}<p>End</p></div><div>Foot</div>") == f"Title\n{LONG}\nEnd\nFoot"
    assert op10_html.main_text(f"<div><p>{LONG}</p></div>{between}<div><p>Foot</p></div>") == LONG


def test_main_text_around_links_and_short_lines():
    link, menu = "<p><a href=x>See the other page</a></p>", "".join(f"<div><a href=x>Entry {k}</a></div>" for k in range(5))
    assert op10_html.main_text(f"<body>{menu}<div><p>{LONG}</p>{link}<p>{LONG} b</p>{link}<p>End</p>{link}</div>") == f"{LONG}\nSee the other page\n{LONG} b\nSee the other page\nEnd"
    assert op10_html.main_text(f"<body>{menu}<div><h1>Title</h1><p>By me</p><p>May 1</p><p>{LONG}</p></div>{menu}") == f"Title\nBy me\nMay 1\n{LONG}"
    entries = "".join(f"<li><a href=x>Entry {k}</a>" for k in range(3))
    assert op10_html.main_text(f"<body><div><p>{LONG}</p><ul>{entries}</ul><p>{LONG} b</p></div>") == f"{LONG}\nEntry 0\nEntry 1\nEntry 2\n{LONG} b"
    assert op10_html.main_text(f"<body><div><p>{LONG}</p></div>{menu}<div><p>{LONG} longer</p></div>") == f"{LONG} longer"
    assert op10_html.main_text("<p>one</p><p>three</p><p>two</p>") == "one\nthree\ntwo"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<script>x", ""), ("<article></article>", ""), ("<p", ""), ("a < b and c", "a < b and c"),
    ("<article><p>x<script>y</script>z</article>", "xz"), ("<div class=ad>ad <article><p>in", "in"), ("<article><p class=notice>no<p>yes</article>", "yes"),
    ("<article><p title='a>b'>q</p></article>", "q"), ("<article>&#233;&eacute;&#xe9;</article>", "ééé"), ("<article><!-- <p>no</p> -->x<!--", "x"),
])
def test_main_text_edges(page, want):
    assert op10_html.main_text(page) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("<>/!-\"'= ab&;") + ["<p>", "</p>", "<article>", "<div class='ad'>", "</div>", "<script>", "<!--", "-->"]), max_size=60).map("".join))
def test_main_text_never_fails(page):
    text = op10_html.main_text(page)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))


def brute_stretch(free, window=3, threshold=60):
    """Of all stretches of lines with text that no line with text adjoins, the largest with a window over the threshold."""
    n = len(free)
    dense = [i for i in range(n) if free[i] and sum(free[i : i + window]) >= threshold]
    dense = dense or [i for i in range(n) if free[i] == max(free) and free[i]][:1]
    whole = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(free[a:b]) and not (a and free[a - 1]) and not (b < n and free[b])]
    return max((x for x in whole if any(x[0] <= i < x[1] for i in dense)), key=lambda x: (sum(free[x[0] : x[1]]), -x[0]), default=(0, 0))


def test_surge_and_dive_against_all_stretches():
    rng = random.Random(4)
    for _ in range(2000):
        free = [rng.choice([0, 0, 5, 19, 30, 200]) for _ in range(rng.randint(0, 12))]
        assert op10_html.surge_and_dive(free) == brute_stretch(free), free


def test_stretches_find_the_text_without_marks(spark):
    """Pages of the tables with their article tags taken out, and with a second, smaller article: the windows alone find the same."""
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = op10_html.main_text(p.html)
        assert op10_html.main_text(re.sub(r"</?article>", "", p.html)) == want
        lines = op10_html.Lines(p.html)
        assert "\n".join(lines.text[slice(*op10_html.surge_and_dive(lines.free, lines=lines))]) == want


def test_headers_of_articles():
    for page in ("<article><div class='article-header'><h1>T</h1></div><p>{}</p></article>", "<div class=post><div class='post-header'><h1>T</h1></div><p>{}</p></div>", "<article><div class=header><h1>T</h1></div><p>{}</p></article>"):
        assert op10_html.main_text(page.format(LONG)) == f"T\n{LONG}"
    assert op10_html.main_text(f"<div class=site-header><h1>T</h1></div><article><p>{LONG}</p></article>") == LONG
    assert op10_html.main_text("<article><p><a href=x>only a link</a></p></article><p><a href=x>another</a></p>") == "only a link"
    assert op10_html.main_text(f"<p>{LONG} beside</p><div><a href=a>m</a></div><div><a href=a>n</a></div><article><p>short</p></article>") == f"{LONG} beside"


@pytest.mark.parametrize("page", ["<div>" + "</b>" * 200_000, "<b>" * 200_000 + "</i>" * 200_000, "<p><div class=ad>" + "<b>" * 100_000 + "</p>" * 100_000 + "</div>", "<a href=x>" * 100_000 + "<i></i>" * 100_000, "<p>x" * 100_000 + "</div>" * 100_000])
def test_broken_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    op10_html.main_text(page)
    assert time.process_time() - began < 4e-6 * len(page) + 1


def test_extract(spark):
    pages = [(1, "u", "<article><p>é x</p></article>"), (2, None, None), (None, "v", "<p>" + "long text here " * 9000), (1, "u", "<article><p>é x</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit("no"), "n_chars": F.lit(1)})
    got = rows(op10_html.extract(df))
    assert (1, "u", "é x", 3) in got and (2, None, "", 0) in got and len(got) == 4 and max(r[3] for r in got) == 9000 * 15 - 1
    assert op10_html.extract(df.limit(0)).collect() == []


def test_pages_of_the_tables(spark, sf_dir):
    """Held against a second reader of these plain pages: all blocks inside article, none outside."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op10_html_extraction(spark, sf_dir).collect()}
    for p in pages:
        body = p.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id] == "\n".join(x for x in blocks if x)


def test_revisits_of_one_response_are_spread(spark):
    """Most revisits are of one URL, a few have none: the same rows however many share a copy, and no task has them all."""
    kind = RECORDS
    table = [(1, "response", "http://a.com/x", 1, {"ETag": "1"}, "body"), (2, "response", "http://a.com/y", 1, {"ETag": "2"}, "other")]
    table += [(10 + k, "revisit", "http://a.com/x", 5 + k, {"etag": "1" if k % 5 else "0"}, None) for k in range(300)]
    table += [(1000 + k, "revisit", ["http://a.com/y", "http://b.com", None][k % 3], 9, {}, None) for k in range(30)]
    df = spark.createDataFrame(table, kind).repartition(4)
    ways = [sorted((repr(r) for r in op8_warc.resolve(df, spread=s).collect())) for s in (10**6, 7, 1)]
    assert ways[0] == ways[1] == ways[2]
    count = Counter(re.search("outcome='([a-z_]+)'", r)[1] for r in ways[0])
    assert count == {"resolved": 240 + 10, "validator_mismatch": 60, "no_response": 20}


# --- all queries


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall())), name
