"""Every operator against a brute-force version, and on awkward tables: nulls, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, extract, fingerprints, maxent_lm, ngram_join, packing, quality, sharding, token_counts, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that clash with names that operators use inside.
CLASH = ["row", "key", "word", "node", "label", "c", "n", "part", "bin", "h", "t", "size", "piece", "freq", "text_hash", "component_id", "score", "seq"]

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    BASE, BASE, BASE + " Alpha", None, "", "  \t ", "one", "One two", "one TWO three", "<|endoftext|> it's A bébé 漢字 cáfé \x1c\x85 x​y",
    " ".join(f"w{i}" for i in range(30_000)), BASE.upper() + "!", "zeta " + BASE, "\U0001F600 " * 5, "a\nb\r\nc\x0bd",
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, BASE), (None, None), (3, None), (0, BASE)]


def docs(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASH))


def key(doc, text):
    return (doc is None, doc or 0, text or "")


@pytest.fixture(scope="module")
def sample(spark):
    return [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts_are_the_library_s(spark, sample):
    from tokenizers import Tokenizer

    rows = DOCS + [(1000 + i, t) for i, t in sample[:60]]
    got = token_counts.token_counts(docs(spark, rows), TOKENIZER, limit=100, heavy=50).collect()
    lib = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, len((t or "").encode()), len(n := lib.encode(t or "", add_special_tokens=False).ids), len(n) > 100) for d, t in rows)
    assert Counter(map(tuple, got)) == want


def windows_brute(rows, items):
    w = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    known = defaultdict(set)
    for i, t in items:
        x = w(t)
        k = min(13, len(x))
        for s in range(len(x) - k + 1 if x else 0):
            known[tuple(x[s : s + k])].add(i)
    sizes = {len(k) for k in known}
    for d, t in rows:
        x, hit, ids = w(t), set(), set()
        for k in sizes:
            for s in range(len(x) - k + 1):
                if (g := tuple(x[s : s + k])) in known:
                    hit |= set(range(s, s + k))
                    ids |= known[g]
        listed = sorted(str(i) for i in ids if i is not None)
        yield d, len(x), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(x)


ITEMS = [(1, BASE), (2, "two"), (10, "ONE two"), (10, "ONE two"), (4, None), (5, "..."), (None, "w5 w6 w7"), (6, "absent words here"), (7, "the the the the")]


def test_contamination(spark, sample):
    rows = DOCS + [(1000 + i, t) for i, t in sample[:40]] + [(2000, "the " * 50), (2001, "x " * 400 + BASE)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = decontaminate.contamination(docs(spark, rows), items).drop("text_hash").collect()
    assert Counter(map(tuple, got)) == Counter(windows_brute(rows, ITEMS))


def test_proximity_finds_a_phrase_with_a_word_put_in(spark):
    d = spark.createDataFrame([(1, BASE.replace("theta", "theta extra")), (2, " ".join(BASE.split()[::-1]))], "key long, text string")
    b = spark.createDataFrame([(1, " ".join(BASE.split()[4:17]))], "item_id long, text string")
    near = decontaminate.proximity_matches(d, b, slack=2).select("key").distinct().collect()
    assert [r[0] for r in near] == [1] and decontaminate.phrase_matches(d, b).count() == 0


def test_a_text_of_one_repeated_word_is_linear_work(spark):
    import time

    rows, items = [(1, "the " * 20_000), (2, "the cat"), (3, "the " * 12)], [(1, "the"), (2, "the " * 13), (3, "the the the"), (4, "cat")]
    began = time.time()
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect()
    assert Counter(map(tuple, got)) == Counter(windows_brute(rows, items)) and time.time() - began < 60


def test_a_stored_index_serves_another_benchmark(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"left w{i} " + BASE + f" right w{i}") for i in range(5)] + [(9, "nothing here")], "key long, text string")
    index = decontaminate.build_index(rows, path=f"file://{tmp_path}/index")
    for text, want in ((BASE, {0, 1, 2, 3, 4}), ("right w3", {3}), ("not there", set())):
        b = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert {r["key"] for r in decontaminate.phrase_matches(rows, b, index=index).collect()} == want
        assert {r["key"] for r in decontaminate.proximity_matches(rows, b, index=index).collect()} == want


PAGE = """<html><head><title>T</title><style>p{margin:0}</style></head><body><nav><a href=x>Home</a></nav><div class="wrap">{}</div><footer>&copy; f</footer></body></html>"""


def test_extraction_of_an_article():
    page = PAGE.replace("{}", '<article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five<ul><li>six<li>seven</ul><div class="share">Share</div><aside>no</aside><div id="comments"><p>Nice</div></article><form><p>x</form>', 1)
    page = page.replace("{}", "")
    blocks, _ = extract.parse(page)
    assert [t for s, _, t, _ in blocks if s == extract.MAIN] == ["Title & more", "One two three four", "Five", "six", "seven"]


def test_style_tree_removes_what_all_pages_of_a_host_share(spark):
    body = lambda i: f'<html><body><div class="top">Welcome to our site</div><div class="txt"><p>Story number {i} about {i * 7}</p><p>More of {i * 13}</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(8)] + [(100, None, None), (101, "http://one.example/", body(5)), (102, "x", ""), (None, "http://h.example/9", body(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1))
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extract.main_text(df).collect()}
    assert got[3, "http://h.example/3"] == ("Story number 3 about 21\nMore of 39", 34) and got[None, "http://h.example/9"][0].startswith("Story number 9")
    assert got[100, None] == ("", 0) and got[102, "x"] == ("", 0) and got[101, "http://one.example/"][0].startswith("Welcome")


def test_style_tree_decides_inside_a_main_region_too(spark):
    body = lambda i: f'<html><body><article><h1>Title {i}</h1><div>Read our other pages</div><p>Story number {i}</p><p>Join our club</p><p>More of {i * 13}</p></article></body></html>'
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(8)] + [(20, "http://one.example/", body(5))] + [(30 + i, "http://same.example/", body(1)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory number {i}\nMore of {i * 13}" for i in range(8))
    # one page says nothing about its host, and a host of equal pages isn't emptied
    assert "Join our club" in got[20] and got[30].startswith("Title 1\nRead our")


def test_a_low_node_goes_with_its_subtree(spark):
    side = lambda i: f'<div class="x"><p>Read all of it</p><p>Good to know</p><span><{"u" if i % 2 else "i"}>Same here</span>{"<dl><dt>Rare one</dl>" if i in (2, 7) else ""}</div>'
    body = lambda i: f'<html><body><section><p>Story {i} of {i * 31}</p><p>More {i * 17}</p></section>{side(i)}</body></html>'
    df = spark.createDataFrame([(i, f"http://h.example/{i}", body(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract.main_text(df).collect()} == {i: f"Story {i} of {i * 31}\nMore {i * 17}" for i in range(12)}


def test_extraction_does_not_hang_on_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r'\s(class|id|role)="[^"]*"', ""))
    texts = [{r["page_id"]: r["text"] for r in extract.main_text(p).collect()} for p in (pages, bare)]
    assert texts[0] == texts[1]


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 100_000 + "x", "<div>x" * 50_000, "<noscript>x" * 50_000, "<script>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "<p/>x" * 50_000,
    '<a "' * 100_000, "<a '<a '" * 50_000, "<li>x" * 50_000, "<" * 500_000, "<!--" * 100_000, "<span>x</i>" * 50_000, "<b><p>x</b>" * 30_000, "&" * 500_000, "<p>" + "word " * 300_000,
], ids=lambda p: f"{p[:12]}-{len(p)}")
def test_parsing_is_linear(page):
    import time

    began = time.process_time()
    extract.parse(page)
    assert time.process_time() - began < 8


def test_extraction_of_the_sample(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract.main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[p["page_id"]] == "\n".join(b for b in parts if b)


def test_quality_separates_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_a_long_labelled_text_does_not_end_the_fitting_rows(spark, monkeypatch):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    first = min(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    d = spark.createDataFrame([(i, ("good words " if i % 2 else "bad stuff ") * (5000 if i == first else 3)) for i in ids], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality.NaiveBayesSvm, "fit", lambda texts, y: seen.append((len(texts), set(y))))
    quality.train(d, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"), most=20_000)
    assert seen == [(len(ids) - 1, {0, 1})]


def test_a_repeated_id_is_fitted_on_one_text_whatever_the_order(spark, monkeypatch):
    rows = [(i, f"good words number {i}" if i % 2 else f"BAD!!! {i}{i}{i}") for i in range(40)] + [(1, "BAD!!! other"), (2, "good other words"), (1, "x")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality.NaiveBayesSvm, "fit", staticmethod(lambda texts, y: seen.append(list(zip(texts, y)))))
    for r in (rows, rows[::-1], sorted(rows, key=str)):
        quality.train(docs(spark, r).repartition(5), labels)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 20


def test_scores_equal_a_plain_sum_over_features():
    texts = [f"fine prose of a kind, {i} of them." if i % 2 else f"buy buy {i} $$$ CLICK http" for i in range(60)]
    model = quality.NaiveBayesSvm.fit(texts, [i % 2 for i in range(60)])
    for t in ["", "a", "fine prose", "CLICK $$$ buy", "fine " * 5000]:
        x = [int(i) for i in quality.features(t)]
        norm = (sum(float(model.r[i]) ** 2 for i in x) + 1) ** 0.5
        margin = sum(float(model.r[i]) * float(model.w[i]) for i in x) / norm + float(model.w[-1])
        assert abs(model.score(t) - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-5
    assert min(model.score(t) for t in texts[1::2]) > max(model.score(t) for t in texts[::2])


def test_quality_on_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, 0), (5, None), (None, 1), (7, 1), (8, 0), (10, 1), (13, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs(spark), labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in DOCS)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    none = quality.quality_scores(docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 3]), np.array([1, 4]), np.array([2, 3]), np.array([2, 4])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    r = quality.log_count_ratio(rows, y)
    w = quality.dual_coordinate_descent(rows, r, y)
    m = quality.NaiveBayesSvm(r, w)
    assert all((m.margin(x) > 0) == bool(t) for x, t in zip(rows, y))


def test_sharding(spark):
    got = sharding.shard(docs(spark, DOCS + [(100 + i, "x" * (i * 7 % 50)) for i in range(2000)]), 24).collect()
    assert len(got) == len(DOCS) + 2000 and {r["law"] for r in got} == {"bytes"}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(24)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    one = {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert {(d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in DOCS} <= one


def shard_bytes(rows):
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    return [held[x] for x in range(24)]


def test_shards_are_near_equal_whatever_the_ids(spark):
    texts = ["x" * (i * 13 % 60) for i in range(6000)]
    for ids in (lambda i: i, lambda i: None if i % 3 else i, lambda i: 7 if i % 3 else i, lambda i: None):
        held = shard_bytes(sharding.shard(docs(spark, [(ids(i), t) for i, t in enumerate(texts)]), 24).collect())
        assert sum(held) == sum(8 + len(t) for t in texts) and max(held) - min(held) <= 2 * 68


def test_a_stored_map_is_edited_and_never_written_twice(spark, tmp_path):
    path, rows = f"file://{tmp_path}/map", docs(spark, [(i, "y" * (i % 90)) for i in range(4000)])
    first = sharding.shard(rows, 24, path=path).collect()
    again = sharding.shard(rows, 24, path=path).collect()
    assert len(again) == len(first) == 4000 and sharding.versions(spark, path) == [1, 2, 3]
    assert {(r["doc_id"], r["shard"]) for r in first} == {(r["doc_id"], r["shard"]) for r in again}  # nothing to mend
    grown = sharding.shard(rows, 25, path=path).collect()
    moved = sum(a["shard"] != b["shard"] for a, b in zip(sorted(first), sorted(grown)))
    assert {r["shard"] for r in grown} == set(range(25)) and moved < 800
    with pytest.raises(Exception, match="exist"):
        sharding.write_map(spark, path, 2, [0] * sharding.SLOTS)
    assert len(sharding.read_map(spark, path, 1).collect()) == sharding.SLOTS


def test_rebalancing_narrows_and_keeps_most_slots():
    sizes = np.random.default_rng(3).integers(0, 1000, 4096).tolist()
    first = sharding.striped(24)
    owner = sharding.rebalanced(first, sizes, 24)
    total = np.bincount(owner, sizes, 24)
    assert total.max() - total.min() <= 2 and np.mean(np.array(owner) == first) > 0.8


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (9, "u", ""), (7, "u", "café"), (2, "again", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "only null")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("clash")).withColumn("sha256", F.lit("clash"))
    path = warc.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # "<p>x</p>", the empty one, cafe, only null
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    got = warc.archive_digest(df).collect()
    assert len(got) == len(rows) and Counter(r["record_type"] for r in got) == {"response": 4, "revisit": 4}
    for r in got:
        if r["record_type"] == "revisit":
            assert r["refers_to"] in (2, 3)
    raw = {bytes(r["payload"]) for r in warc.read_archive(spark, path).collect()}
    assert raw == {(h or "").encode() for _, _, h in rows}
    assert {r["payload_digest"] for r in got} == {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}
    records = {bytes(r["record"]) for r in warc.read_archive(spark, path).collect()}
    assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records) and not any(b"\r\nX: y" in x for x in records)


def test_damaged_archives_are_not_read(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "b"))
    bad = spark.read.parquet(f"{path}/payloads").select("sha256", F.lit(zlib.compress(b"abd", 6, 31)).alias("packed"))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def check_packing(rows, got, room):
    from tokenizers import Tokenizer

    lib, seen, bins = Tokenizer.from_file(TOKENIZER), defaultdict(int), defaultdict(list)
    ids = {key(d, t): [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
        assert any(d[1] == (r["doc_id"] or 0) and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for d, x in ids.items())
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= room
    want = defaultdict(int)
    for d, t in rows:
        want[d] += len(ids[key(d, t)])
    assert seen == want
    return len(bins), -(-sum(want.values()) // room)


def test_packing(spark, sample):
    rows = DOCS + [(1000 + i, t) for i, t in sample[:100]]
    used, least = check_packing(rows, packing.pack(docs(spark, rows), TOKENIZER, 4096, 1, group=60).collect(), 4096)
    assert used <= least + 1


def test_local_search_empties_a_bin():
    lengths = [50, 30, 20, 40, 35, 25]  # three bins of which two are enough
    out = packing.improve([[0, 1], [3, 4], [2, 5]], lengths, 100)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6))


def test_base_scores_are_exact_and_the_model_is_better(spark, sample):
    rows = DOCS + [(1000 + i, t) for i, t in sample]
    got = maxent_lm.scores(docs(spark, rows)).collect()
    words = lambda t: [w for w in re.split("[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w] + ["\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(w := words(t)), sum(x in c for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def tiny_tree():
    v = maxent_lm.Vocabulary({b"a": 50, b"b": 30, b"of": 9, **{b"w%d" % i: 1 + i % 5 for i in range(90)}, maxent_lm.END: 20})
    classes = np.concatenate((np.arange(maxent_lm.RARE) // (maxent_lm.RARE // maxent_lm.FAN), v.classes))
    return v, maxent_lm.Tree(classes, np.concatenate((np.full(maxent_lm.RARE, 0.3), v.count + 0.1)), 1 << 11)


def test_the_model_is_proper():
    v, tree = tiny_tree()
    weights = np.random.default_rng(0).normal(size=(tree.rows, maxent_lm.FAN)).astype(np.float32)
    words = [b"zz", *v.words]
    for before in ([b"a", b"of"], [b"zz"], []):
        codes = maxent_lm.Coder(v)([*before, b"a"])
        hashes = maxent_lm.contexts(codes, np.array([0]))[:, -1:]
        every = np.concatenate((-1 - np.arange(maxent_lm.RARE), np.arange(len(v.words)))).astype(np.int32)  # one code of each leaf
        p = maxent_lm.log_probabilities(tree, weights, every, np.repeat(hashes, len(every), 1))
        assert abs(np.exp(p).sum() - 1) < 1e-4 and len(words) > 90


def test_a_text_s_tokens_keep_their_context_in_every_batch():
    v, tree = tiny_tree()
    random = np.random.default_rng(1)
    weights = random.normal(size=(tree.rows, maxent_lm.FAN)).astype(np.float32)
    texts = [random.choice([*v.words, b"new", b"other"], n).tolist() for n in (1, 70_000, 3)]
    codes = [(k, maxent_lm.Coder(v)(t)) for k, t in enumerate(texts)]

    def sums(batch):
        out = np.zeros(3)
        for c, h, own in maxent_lm._runs(codes, batch):
            out += np.bincount(own, maxent_lm.log_probabilities(tree, weights, c, h), 3)
        return out

    assert np.allclose(sums(1 << 20), sums(100), rtol=1e-6)


def test_model_scores_equal_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 11))) for i in range(60)] + [(None, "w1 w2 new"), (3, None), (70, "rare " * 4 + "w1 w1")]
    model = maxent_lm.Model(docs(spark, rows), rounds=2, heavy=6)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in model.scores().collect())
    t, v, w = model.tree, model.vocabulary, model.weights
    c = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    assert abs(w).max() > 0
    outcomes, want = np.zeros_like(w), []
    for d, text in rows:
        ws = [*maxent_lm.words_of(text or ""), maxent_lm.END]
        codes = [int(x) for x in maxent_lm.Coder(v)(ws)]
        total = 0.0
        for i, word in enumerate(ws):
            hashes = maxent_lm.contexts(np.array(codes[max(0, i - 2) : i + 1], np.int32), np.array([0]))[:, -1]
            leaf = v.codes[word] + maxent_lm.RARE if word in v.codes else v.leaf_of(word)
            for j in range(t.start[leaf], t.start[leaf] + t.depth[leaf]):
                node, k = t.nodes[j], t.outcomes[j]
                at = [int(t.base[node]) + (int(h) * int(t.size[node]) >> 32) for h in hashes]
                z = [float(t.bias[node][x]) + sum(float(w[r][x]) for r in at) for x in range(maxent_lm.FAN)]
                total += (z[k] - np.log(sum(np.exp(x) for x in z))) / np.log(10)
                if zlib.crc32(str(d or "").encode() if d is None else str(d).encode()) % 10:
                    for r in at:
                        outcomes[r][k] += 1
            total += t.below[leaf] / np.log(10)
            if word not in v.codes:
                total += np.log10((c.get(word, 0) + 0.1) / model.mass[leaf])
        want.append((str(d), len(ws), round(total, 3)))
    assert [g[:2] for g in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([g[2] for g in got], [x[2] for x in sorted(want)], atol=0.01)
    assert np.array_equal(outcomes, model.outcomes)


def test_gradient_rounds_raise_the_training_likelihood(spark, sample):
    rows = [(1000 + i, t) for i, t in sample]
    sums = [maxent_lm.Model(docs(spark, rows), rounds=n).scores().where("NOT held_out").agg(F.sum("score")).first()[0] for n in (0, 2)]
    assert sums[1] > sums[0]


def brute_groups(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_similar_groups(spark, k, num):
    g = np.random.default_rng(k)
    rows = list(DOCS)
    for base in range(12):  # chains of copies with ever more changed words, of all sizes about the light-heavy boundary
        w = [f"b{base}w{i}" for i in g.integers(0, 10**6, int(g.integers(6, 90)))]
        for copy in range(8):
            rows.append((100 * (base + 1) + copy, " ".join(w)))
            if copy % 2:
                w[int(g.integers(len(w)))] = f"c{copy}"
    got = ngram_join.similar_groups(docs(spark, rows), k, num, 100).collect()
    assert Counter(map(tuple, got)) == brute_groups(rows, k, num, 100)


def test_light_and_heavy_keys_meet():
    g = np.random.default_rng(9)
    for num in (80, 90):
        for boundary in (0, 8, 20):
            s = ngram_join.Scheme(num, 100, boundary)
            for _ in range(300):
                n = int(g.integers(1, 60))
                a = np.unique(g.integers(0, 1 << 62, n).astype(np.uint64))
                b = a.copy()
                for _ in range(int(g.integers(0, 6))):
                    kind = g.integers(3)
                    if kind == 0 and len(b) > 1:
                        b = np.delete(b, g.integers(len(b)))
                    else:
                        b = np.append(b[1:] if kind == 1 else b, np.uint64(g.integers(1 << 62)))
                b = np.unique(b)
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both):
                    assert len(np.intersect1d(s.keys(a), s.keys(b))), (num, boundary, len(a), len(b), both)


def test_fingerprints(spark, sample):
    rows = DOCS + [(1000 + i, t) for i, t in sample[:60]]
    got = fingerprints.edit_likeness(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: key(*r))
    want = Counter()
    for i, (d, t) in enumerate(order):
        a, b = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(a) // 2
        want[d, len(a), hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and len(r["fingerprint"]) == 256 for r in got)
    same = fingerprints.fingerprint(docs(spark)).select("text", "fingerprint").distinct().collect()
    assert len({r["fingerprint"] for r in same if r["text"] == BASE}) == 1


def plain_fingerprint(text, words=5, bins=128):
    """One-permutation MinHash step by step, with the library's own xxhash64 as Spark has it (seed 42, chained over values)."""
    import xxhash

    def chain(raws, h=42):
        for raw in raws:
            h = xxhash.xxh64_intdigest(raw, h)
        return h

    long = lambda x: (x % 2**64).to_bytes(8, "little")
    w = [long(chain([x.encode()])) for x in re.split("[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    hashes = [] if not w else [chain(w)] if len(w) < words else [chain(w[i : i + words]) for i in range(len(w) - words + 1)]
    least = {}
    for h in hashes:
        h &= 2**63 - 1
        least[h >> 56] = min(h, least.get(h >> 56, h))
    if not least:
        return "ff" * bins
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    out = []
    for b in range(bins):
        y = least[b] if b in least else min((signed(chain([b.to_bytes(4, "little"), long(c)])), least[c]) for c in least)[1]
        out.append(f"{y & 255:02x}")
    return "".join(out)


def test_fingerprints_equal_brute_force(spark, sample):
    rows = DOCS + [(1000 + i, t) for i, t in sample[:40]]
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(docs(spark, rows)).collect() if r["doc_id"] and r["doc_id"] >= 1000}
    order = [t or "" for d, t in sorted(((d, t) for d, t in rows if d and d >= 1000), key=lambda r: r[0])]
    like = lambda x, y: max(0.0, (sum(x[i : i + 2] == y[i : i + 2] for i in range(0, 256, 2)) / 128 - 1 / 256) / (1 - 1 / 256))
    for i, (a, b) in enumerate(zip(order, order[1:])):
        r, h = got[1000 + i], len(a) // 2
        edited, prints = a[: len(a) - h] + b[:h], [plain_fingerprint(x) for x in (a, b)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[0], plain_fingerprint(edited))
        assert abs(r["near_edited"] - like(prints[0], r["edited_fingerprint"])) < 1e-9 and abs(r["near_next"] - like(*prints)) < 1e-9


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5, lambda i: None if i % 2 else i, lambda i: i % 3])
def test_every_row_of_repeated_ids_has_one_next_row(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 40)
    rows = [(ids(i), f"text number {i} of some words") for i in range(500)]
    ranges = fingerprints._ranges(docs(spark, rows).select("doc_id", "text"))
    assert ranges.groupBy("part").count().agg(F.max("count")).first()[0] < 200
    got = fingerprints.edit_likeness(docs(spark, rows)).collect()
    lasts = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest(): (x, y) for x, (d, a) in enumerate(rows) for y, (e, b) in enumerate(rows)}
    pairs = [lasts[r["edited_sha256"]] for r in got]
    assert len(got) == 500 and len({x for x, _ in pairs}) == 500


def test_fingerprint_likeness_is_unbiased(spark):
    g = np.random.default_rng(4)
    rows, want = [], []
    for i in range(60):
        a = [f"w{x}" for x in g.integers(0, 10**6, 150)]
        b = a[: int(g.integers(20, 150))] + [f"v{x}" for x in g.integers(0, 10**6, 60)]
        rows.append((i, " ".join(a), " ".join(b)))
        s, t = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
        want.append(len(s & t) / len(s | t))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    df = fingerprints._with_bins(fingerprints._with_bins(df, "a", "x", 5, 128), "b", "y", 5, 128)
    got = [r[0] for r in df.orderBy("i").select(fingerprints.likeness("x", "y", 128)).collect()]
    assert abs(np.mean(np.array(got) - want)) < 0.015 and np.sqrt(np.mean((np.array(got) - want) ** 2)) < 0.07


@pytest.mark.parametrize("run", [
    lambda d, p, x: token_counts.token_counts(d, TOKENIZER), lambda d, p, x: decontaminate.contamination(d, x), lambda d, p, x: extract.main_text(p),
    lambda d, p, x: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))), lambda d, p, x: sharding.shard(d), lambda d, p, x: warc.archive_digest(p),
    lambda d, p, x: packing.pack(d, TOKENIZER), lambda d, p, x: maxent_lm.scores(d), lambda d, p, x: ngram_join.similar_groups(d), lambda d, p, x: fingerprints.edit_likeness(d),
], ids=["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, run):
    d = docs(spark, []).limit(0)
    p = spark.createDataFrame([], "page_id long, url string, html string")
    x = spark.createDataFrame([], "item_id long, text string")
    assert run(d, p, x).count() == 0


def test_lm_driver_holds_little(spark, monkeypatch):
    """Beside the weights the driver has tables of half their size, no words once they are coded, and no whole table of letters."""
    import tracemalloc

    words = [b"w%d" % (i * 7919) for i in range(3 * maxent_lm.SLICE)]
    tracemalloc.start()
    letters = maxent_lm._letters(words)
    peak = tracemalloc.get_traced_memory()[1]
    assert letters.sum() == sum(map(len, words)) and peak < 2 * letters.nbytes

    monkeypatch.setattr(maxent_lm, "LEAST_BITS", 17)
    rows = [(i, f"a b{i % 7} c{i % 5} d a") for i in range(200)]
    tracemalloc.reset_peak()
    start = tracemalloc.get_traced_memory()[0]
    model = maxent_lm.Model(docs(spark, rows))
    peak = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    size = model.weights.nbytes
    assert model.weights.any() and not any(isinstance(x, maxent_lm.Vocabulary) for x in vars(model).values())
    assert peak < 3.2 * size, peak / size


def test_ngram_rows_leave_a_worker_in_small_batches():
    """A worker holds the keys and sketches of few rows at a time, whatever the size of the batch that it gets."""
    from types import SimpleNamespace

    import pyarrow as pa

    texts = [f"a b c d e f g {i}" for i in range(700)] + ["", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(702)), pa.array(texts), pa.array(range(702))], names=["doc_id", "t", "text_hash"])
    every = SimpleNamespace(value=SimpleNamespace(has=lambda keys: np.ones(len(keys), bool)))
    out = list(ngram_join._documents(5, ngram_join.Scheme(80, 100, 5), every)([batch]))
    assert max(b.num_rows for b in out) <= 256
    shingles, rows = ngram_join.Shingles(5), pa.Table.from_batches(out).to_pylist()
    assert [r["doc_id"] for r in rows] == [r["text_hash"] for r in rows] == list(range(702))
    for r, t in zip(rows, texts):
        h = shingles.of(t)
        assert r["n"] == len(h) and [r[f"b{i}"] for i in range(ngram_join.SKETCH)] == ngram_join.sketch(h).tolist()
        assert r["node"] == (int(ngram_join.node_of(h)) if len(h) else None)
