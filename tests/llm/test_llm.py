"""The training-data operators on small fixtures, against brute force."""

import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigweave.llm import attention_lm, bpe, decontaminate, html_consensus, media, near_dedup, packing, quality_kn, shard_shuffle, token_store, url_cascade

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int"
RNG = random.Random(5)
WORDS = ["the", "thing", "other", "erent", "tion", "reand", "shed", "ofin", "onble", "wher", "ingth", "ator", "hely", "andre"]


def sentence(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n))


TEXTS = [None, "", " ", "a", sentence(400, 1), sentence(400, 1), sentence(40, 2), "é ü\nñ  x   y 漢字 'tis", "BM RIFF P5 " + sentence(30, 3), "the " * 3000, sentence(60, 4) + " tail", sentence(60, 4) + " other"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], f"s{i % 3}" if i else None, 1, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def pages(spark):
    body = lambda i: f"<html><body><nav><a href='/'>menu</a></nav><div class='ad9'>buy &amp; buy</div><article><h1>Title {i}</h1><p>{sentence(30, i)} &lt;x&gt;<br>more<p>last  &eacute;</article><div id=comments>nice</div><footer>foot</footer>"
    rows = [(i, f"http://WWW.Example.org/{['en/1', 'es/2', 'fr/3'][i % 3]}?q={i}", body(i)) for i in range(6)]
    rows += [(6, None, None), (7, "no scheme", ""), (8, "https://a.net/x#y", "<p>only <b>this"), (8, "https://a.net/x#y", "<p>only <b>this"), (9, "ftp://b.com", "<script>x='<p>'</script>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_bpe_equals_the_tokenizer():
    texts = [*(t or "" for t in TEXTS), "a  b", "a   b", "a \n b ", " x", "\n", "it's  don't", "a　 b", "x × y", "Ġ Ġa", "\x1c b"]
    tk = Tokenizer.from_file(BPE)
    tk.encode_special_tokens = True
    ids, counts = bpe.BpeEncoder(BPE).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts):
        assert ids[e - n : e].tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_bpe_looks_pretokens_up_in_arrays(monkeypatch):
    """Ids lie end to end in one array; what was met before is not encoded again; ids are right past the cache's end too."""
    monkeypatch.setattr(bpe, "CACHE", 60)
    enc = bpe.BpeEncoder(BPE)
    words = pa.array([" an", "an", "  ", " unheard-ofish", ".", "zß", "\n"], pa.large_string())
    for turn in range(2):
        store, begin, n = enc._look_up(words)
        assert [store[a : a + k].tolist() for a, k in zip(begin, n)] == [enc.whole.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]
        monkeypatch.setattr(enc, "_encode_new", None)  # nothing new is left
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "CACHE", 60)
    for k in range(6):
        texts = [sentence(20, 50 * k + i) + f" x{k}y{i}, né" for i in range(4)]
        ids, counts = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.known) <= 61


def test_bpe_cuts_long_texts_and_reads_slices(monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 300)
    texts = ["a", sentence(900, 3) + "  x \n " + sentence(200, 4), None, "é" * 2000, "漢字 " * 400, "it's " * 300]
    tk = Tokenizer.from_file(BPE)
    ids, counts = bpe.BpeEncoder(BPE).encode(pa.array(["skip", *texts]).slice(1))
    for t, e, n in zip(texts, np.cumsum(counts), counts):
        assert ids[e - n : e].tolist() == tk.encode(t or "", add_special_tokens=False).ids


def expected_ids(end):
    tk = Tokenizer.from_file(BPE)
    return [np.array([*tk.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in TEXTS]


def test_token_store(docs, empty):
    got = {r["doc_id"]: r for r in token_store.op10_simple8b(docs, BPE).collect()}
    start = 0
    for i, ids in enumerate(expected_ids(0)):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.op10_simple8b(empty, BPE).count() == 0


def test_packing(docs, empty):
    rows = packing.op3_drr_packing(docs, BPE).collect()
    ids = expected_ids(1)
    for i, own in enumerate(ids):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))] and sum(r["length"] for r in mine) == len(own)
        assert all(r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own) for r in mine)
    total = sum(map(len, ids))
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert len(fill) == -(-total // 2048) and all(n == 2048 for s, n in fill.items() if s < len(fill) - 1)
    assert packing.op3_drr_packing(empty, BPE).count() == 0


def by_windows(rows, source_of):
    """Tokens of each source in each window."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], Counter())[source_of[r["doc_id"]]] += r["length"]
    return [held[i] for i in range(len(held))]


def test_packing_keeps_to_targets_unlike_the_natural_shares(spark):
    """Over many frames, while all queues hold text, no source is more than two runs off its target in all windows so far."""
    rows = [(i, f"s{i % 2}" if i % 7 else None, sentence(40 + i % 150, 300 + i)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = packing.pack(df, BPE, targets={"s0": 0.7, "s1": 0.2, None: 0.1}, window=512, frame_ids=1 << 14).collect()
    source_of = {i: s for i, s, _ in rows}
    tokens = Counter()
    for r in out:
        tokens[source_of[r["doc_id"]]] += r["length"]
    whole = min(tokens["s0"] / 0.7, tokens["s1"] / 0.2, tokens[None] / 0.1)
    held, so_far, at = by_windows(out, source_of), Counter(), 0
    assert whole > 5 * (1 << 14)
    for own in held[: int(whole) // 512 - 2]:
        so_far.update(own)
        at += 512
        for s, share in (("s0", 0.7), ("s1", 0.2), (None, 0.1)):
            assert abs(so_far[s] - share * at) <= 2 * packing.RUN, (at, s)
    assert all(sum(own.values()) == 512 for own in held[:-1]) and sum(tokens.values()) == sum(sum(o.values()) for o in held)
    # Pieces of a document follow each other without gap.
    for i in range(600):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in out if r["doc_id"] == i)
        assert [m[0] for m in mine] == [sum(x[1] for x in mine[:k]) for k in range(len(mine))] and sum(m[1] for m in mine) == mine[0][2]


def test_packing_serves_untargeted_sources_last(spark):
    rows = [(i, f"s{i % 3}", sentence(200, 400 + i)) for i in range(90)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string"), BPE, targets={"s0": 1.0}, window=512, frame_ids=1 << 14).collect()
    order = [f"s{r['doc_id'] % 3}" for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert "s0" not in order[order.index("s1") + 60 :] and set(order) == {"s0", "s1", "s2"}


def test_schedule_keeps_to_the_shares():
    lengths = [300] * 200
    queue = [0] * 100 + [1] * 60 + [2] * 40
    pieces = packing.schedule(lengths, queue, lambda a, b: [s * (b - a) for s in (0.5, 0.3, 0.2)], [0.0, 0.0, 0.0], 0)
    for stop in range(2048, 50_000, 2048):
        served = Counter()
        for d, _, n, at in pieces:
            if at < stop:
                served[queue[d]] += n
        assert all(abs(served[s] - share * stop) <= 2 * packing.RUN for s, share in enumerate((0.5, 0.3, 0.2)))


def test_shards(docs, empty, spark):
    rows = shard_shuffle.op2_external_shuffle(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    sizes = Counter(r["shard"] for r in rows)
    assert set(range(8)) >= set(sizes) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        b = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 1, zlib.crc32(b))
    assert shard_shuffle.op2_external_shuffle(empty).count() == 0
    clash = docs.withColumn("Shard", F.col("doc_id") + 100).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(1))
    for r in shard_shuffle.external_shuffle(clash).collect():
        assert (r["Shard_"], r["row"], r["bucket"]) == (r["doc_id"] + 100, 1, 1) and 0 <= r["shard"] < 8
    assert shard_shuffle.external_shuffle(docs.union(docs), bucket_bytes=2000).count() == 2 * len(TEXTS)
    tags = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("z"), F.col("doc_id"), F.lit("a"), F.lit(None).cast("long")))
    mapped = shard_shuffle.external_shuffle(docs.withColumn("tags", tags).union(docs.withColumn("tags", tags))).collect()
    assert len(mapped) == 2 * len(TEXTS)
    for r in mapped:
        assert r["tags"] == ({"z": r["doc_id"], "a": None} if r["doc_id"] % 3 else None)


def test_shards_of_a_repeated_key(spark, monkeypatch):
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 6 == 0, "same").otherwise(F.concat(F.lit("x"), "id")).alias("text"))
    copies = shard_shuffle.numbered(rows.select(F.struct("*").alias("row")), 17).filter("row.doc_id is null and row.text = 'same'").select("copy").collect()
    assert sorted(r["copy"] for r in copies) == list(range(100))
    monkeypatch.setattr(shard_shuffle, "RUN", 7)
    monkeypatch.setattr(shard_shuffle, "MIN_CHECKED", 1)
    out = shard_shuffle.external_shuffle(rows, n_shards=1, bucket_bytes=100).collect()
    assert sorted(r["text"] for r in out) == sorted(r["text"] for r in rows.collect())
    # Keyless rows lie among the others, not in one bucket.
    places = [r["slot"] for r in out if r["doc_id"] is None]
    assert len(places) == 200 and max(places) - min(places) > 500


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i if i % 3 else None, "same" if i % 6 == 0 else sentence(20, i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = set()
    for n in (1, 3, 7):
        out = shard_shuffle.external_shuffle(df.orderBy(F.xxhash64("text", F.lit(n))).repartition(n), bucket_bytes=3_000).collect()
        seen.add(tuple(sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["text"]) for r in out)))
    assert len(seen) == 1
    assert seen != {tuple(sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["text"]) for r in shard_shuffle.external_shuffle(df, seed=18, bucket_bytes=3_000).collect()))}


def test_media(docs, empty):
    for r in media.op5_signature_sniffing(docs).collect():
        b = (TEXTS[r["doc_id"]] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert media.op5_signature_sniffing(empty).count() == 0


@pytest.mark.parametrize("kind", media.KINDS)
def test_sniffing_carves(kind):
    data = media.store(media.pad(b"RIFF BM P5 .snd" * 50), kind)
    for lead in (b"", b"BM noise RIFF"):
        (hit,) = media.sniff(lead + data + b" P5 tail")
        assert (hit.kind, hit.offset, hit.length) == (kind, len(lead), len(data))
    assert media.sniff(data[:-1]) == []


def test_url_rules_and_cascade(pages, spark):
    rows = {r["page_id"]: r for r in url_cascade.op8_url_cascade(pages).collect()}
    assert (rows[0]["host"], rows[0]["path"], rows[0]["rule"], rows[0]["verdict"]) == ("www.example.org", "/en/1", "example.org/en/1", "block")
    assert rows[1]["rule"] == "example.org/es/" and rows[2]["rule"] == "org/" and rows[2]["verdict"] == "allow"
    assert rows[6]["host"] == rows[6]["path"] == rows[7]["host"] == "" and rows[9]["path"] == "" and rows[9]["rule"] is None
    assert url_cascade.op8_url_cascade(pages.limit(0)).count() == 0
    assert rows[8]["verdict"] == ("block" if hashlib.md5(b"a.net/x").hexdigest()[0] in "01" else "allow")


@pytest.mark.parametrize("every, pass_keys", [(7, 10_000), (500, 10_000), (3, 200)])
def test_cascades_are_exact(spark, every, pass_keys):
    """With few and many listed keys, in one pass and in several; rows repeat, and have null keys and a column of the new one's name."""
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % every == 0).alias("listed"))
    cascades = url_cascade.build_cascades(keys, pass_keys)
    assert len(cascades) == -(-3000 // every // pass_keys) or every == 3 and len(cascades) == 5
    rows = keys.union(keys).withColumn("found", F.lit("x"))
    got = url_cascade.with_membership(rows, "key", cascades, "found")
    assert got.filter("found <> listed").count() == 0 and got.count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_html(pages):
    rows = {r["page_id"]: r for r in html_consensus.op9_consensus_paths(pages).collect()}
    for i in range(6):
        assert rows[i]["text"] == f"Title {i}\n{sentence(30, i)} <x> more\nlast é"
        assert rows[i]["n_chars"] == len(rows[i]["text"])
    assert rows[6]["text"] == rows[7]["text"] == rows[9]["text"] == "" and rows[8]["text"] == "only this"
    assert html_consensus.op9_consensus_paths(pages.limit(0)).count() == 0
    assert html.unescape("&eacute;") == "é"


def test_html_keeps_the_whole_article(spark):
    lead, body, side = sentence(20, 71), sentence(110, 72), sentence(8, 73)
    split = f"<body><div class='post'><div class='lead'>{lead}</div><div class='text'>{body}</div></div></body>"
    section = f"<body><div class='post'><p>{lead}</p><section>{body}</section></div></body>"
    wrapped = f"<body><div class='layout with-sidebar'><div class='text'>{body}</div><div class='sidebar'>{side}</div></div></body>"
    other = f"<body><div class='text'>{side}</div><main>{body}</main></body>"
    plain = f"<body><div class='text'>{lead}</div></body>"
    pages = [split, section, wrapped, other, plain, plain]
    df = spark.createDataFrame([(i, "http://a.org/" + str(i), p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_consensus.op9_consensus_paths(df).collect()}
    assert got == {0: f"{lead}\n{body}", 1: f"{lead}\n{body}", 2: body, 3: body, 4: lead, 5: lead}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article class='related-work'><p>one two three four</p></article></body>", "one two three four"),
        ("<body><div class='search-engines post'><p>one two three four</p></div></body>", "one two three four"),
        ("<body><article><p>one two<button>three<p>four five</article></body>", "one two three\nfour five"),
        ("<body><article><p>one two<button>press</button> three</article></body>", "one two three"),
        ("<body><article><p class='x>one two</p><p id=y>three four</p></article></body>", "one two\nthree four"),
        ("<body><article><p class=\"x>one two</p><p class=\"y\">three four</p></article></body>", "one two\nthree four"),
        ("<body><header>site</header><article><header><h1>Head <b>line</b></h1><span>by me</span></header><p>one two three four</p></article></body>", "Head line\none two three four"),
        ("<body><article><p title='a > b'>one</p><script>if (a < b) '<p>x'</script><p>two &amp; three</p><!-- <p>no</p> --></article>", "one\ntwo & three"),
        ("<body><article><p>one two three<p>four</article><div class='comments'><p>nice</div><script>open", "one two three\nfour"),
        ("<body><div class='ad'>" + "buy this now. " * 30 + "</div><article><h1>One</h1><p><b>two.<br></article>", "One\ntwo."),
        ("<body><article><p>one two</p><div class='ad-box'>" + "buy. " * 30 + "</div><p>three</article>", "one two\nthree"),
        ("<body><article><p>one two</article><div id='comments'><article class='comment'>" + "nice. " * 30 + "</article></div>", "one two"),
        ("<body><div class='layout with-sidebar'><article><p>one two</article><div class='sidebar'>" + "more. " * 30 + "</div></div>", "one two"),
        ("<body><div class='cookiebar'>we use them, all of them, day by day</div><div class='post'><p>one two</div>", "one two"),
        ("<body><div class='ad'>" + "buy. " * 30 + "</div><div class='post'><p>one two</div>", "one two"),
        ("<body><div class='comments'>nothing but talk</div>", ""),
        ("<body><div class='widget'><article>all there is</article></div>", "all there is"),
    ],
)
def test_html_pages(page, text):
    found = html_consensus.blocks(page)
    assert html_consensus.extract(found, None) == text


def test_html_of_short_articles_has_no_adverts(spark):
    """On each page of the given table the text is all that its article element holds, and no advert's."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_consensus.op9_consensus_paths(pages).collect()}
    bare = lambda part: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split())
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if article:
            assert got[r["page_id"]].split() == bare(article[1]).split(), r["page_id"]


def plain_similarity(a, b):
    words = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x) for x in t.lower().split()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    x, y = grams(words(a)), grams(words(b))
    return sum((x & y).values()) / sum((x | y).values())


def test_near_duplicates(spark):
    rows = []
    for g in range(12):
        base = sentence(200, 100 + g).split()
        for c in range(6):
            words = list(base)
            if c:
                words[37 * c % 200] = f"new{g}x{c}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", None, "one two", "One, two!", rows[0][1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert len(cls) == len(rows)
    for g in range(12):
        assert {cls[6 * g + c] for c in range(6)} == {6 * g}
    assert cls[72] == cls[73] == cls[74] == 72 and cls[75] == cls[76] == 75 and cls[77] == 0
    assert plain_similarity(rows[1][1], rows[2][1]) > 0.8
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.keep_one(df).count() == 14


def test_near_duplicates_test_every_pair_of_a_bucket(spark, monkeypatch):
    """Texts of one template, below the threshold to each other, with near-duplicate pairs among them."""
    template, texts = sentence(160, 41).split(), []
    for g in range(150):
        own = [f"own{g}x{k}" for k in range(32)]
        words = template + own
        texts.append(" ".join(words))
        if g % 10 == 0:
            texts.append(" ".join([*words[:-1], f"last{g}"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, at = {}, 0
    for g in range(150):
        want[at] = at
        if g % 10 == 0:
            want[at + 1] = at
            at += 1
        at += 1

    def one_bucket(batches, levels):
        for batch in batches:
            bands = pa.array([[1] for _ in range(batch.num_rows)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], names=["doc_id", "digest", "bands"])

    monkeypatch.setattr(near_dedup, "_signed", one_bucket)
    for few in (32, 1):
        monkeypatch.setattr(near_dedup, "FEW", few)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == want


def test_crowded_buckets_compare_few_pairs(spark, monkeypatch):
    """Texts of one template, each with other words replaced, share a bucket: few pairs are compared, no link is lost."""
    rng, template, texts = np.random.default_rng(8), [f"t{k}" for k in range(150)], []
    for g in range(240):
        words = list(template)
        for k in rng.choice(150, 1 if g % 3 == 0 else 3, replace=False):
            words[k] = f"own{g}x{k}"
        texts.append(" ".join(words))
        if g % 40 == 1:  # alike only to the one before it
            texts.append(" ".join([*words[:-1], f"last{g}"]))
    df, compared, real = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], near_dedup.materialize

    def one_bucket(batches, levels):
        for batch in batches:
            bands = pa.array([[1] for _ in range(batch.num_rows)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], names=["doc_id", "digest", "bands"])

    def counted(df, tag, *more):
        out = real(df, tag, *more)
        if tag == "pairs":
            compared.append(out.count())
        return out

    levels = near_dedup.idf_levels(df)
    ids, tf, n = near_dedup.profile(pa.array(texts))
    weights, ends = (tf * near_dedup.level_weight(levels[near_dedup.bucket_of(ids)].astype(float))).astype("<f4"), np.cumsum(n)
    of = [(ids[e - k : e], weights[e - k : e]) for e, k in zip(ends, n)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and near_dedup.weighted_jaccard(*of[a], *of[b]) >= near_dedup.THRESHOLD:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    monkeypatch.setattr(near_dedup, "_signed", one_bucket)
    monkeypatch.setattr(near_dedup, "materialize", counted)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == dict(enumerate(root))
    assert len(set(root)) < len(texts) - 60 and sum(compared) < 8 * len(texts)


def test_bounds_without_a_row_for_each_shingle(spark, monkeypatch):
    """Bounds equal those by exact counts of each shingle, and no table that is written has a row for each shingle."""
    rng, n, wide = np.random.default_rng(12), 60, 400
    common, rows = rng.integers(0, 1 << 44, 500).astype("<u8"), []
    for node in range(n):
        ids = np.unique(np.concatenate([rng.choice(common, wide * 9 // 10, replace=False), rng.integers(0, 1 << 44, wide // 10 if node % 5 else wide).astype("<u8")]))
        weights = rng.random(len(ids)).astype("<f4") + np.float32(1)
        rows.append((node, float(weights.sum()), ids.tobytes(), weights.tobytes()))
    of = [dict(zip(np.frombuffer(r[2], "<u8").tolist(), np.frombuffer(r[3], "<f4").tolist())) for r in rows]
    seen, written, real = Counter(k for d in of for k in d), [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, *more: written.append(real(df, *more)) or written[-1])
    got = {r["node"]: r for r in near_dedup.bounds(spark.createDataFrame(rows, near_dedup.VECTORS).repartition(3), 0.8).collect()}
    for node, d in enumerate(of):
        cap = sum(w for k, w in d.items() if seen[k] > 1)
        assert (node in got) == (cap >= 0.8 * rows[node][1]) == (node % 5 > 0)
        if node in got:
            assert got[node]["cap"] == pytest.approx(cap) == sum(got[node]["parts"]) and len(got[node]["parts"]) == near_dedup.PARTS
            assert got[node]["h"] == pytest.approx(1 - cap / rows[node][1])
    assert all(df.count() <= n for df in written)
    assert near_dedup.bounds(spark.createDataFrame([], near_dedup.VECTORS), 0.8).count() == 0


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(1 << 44, 400, replace=False).astype(np.uint64))
    s, hits = near_dedup.Sampler(), []
    a, b = ids[:300], ids[60:360]
    for ids_, out in ((a, []), (b, [])):
        hits.append(s.signatures(ids_, np.ones(len(ids_), np.int64), np.full(len(ids_), 31), np.array([0])))
    assert abs((hits[0] == hits[1]).mean() - 240 / 360) < 0.25


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 40)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[40] == 30


def test_leaks(spark):
    items = [(0, sentence(30, 500)), (1, sentence(18, 501)), (2, "three word item"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = items[0][1].split()
    near[-1] = "changed"
    docs = [(0, sentence(50, 7) + " " + items[0][1] + " " + sentence(50, 8)), (1, items[1][1].upper()), (2, sentence(80, 9) + " " + " ".join(near)), (3, "has a three word item in"), (4, sentence(300, 10)), (5, None), (6, ""), (7, " ".join(items[0][1].split()[:15]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_simhash_windows(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 0), (3, 2)}
    assert {r["doc_id"] for r in decontaminate.drop_leaked(df, bench).collect()} == {4, 5, 6, 7}
    assert decontaminate.op1_simhash_windows(df.limit(0), bench).count() == 0
    assert decontaminate.op1_simhash_windows(df, bench.limit(0)).count() == 0


def exhaustive_leaks(docs, items):
    """(document, item): the best weighted similarity of any window of the item's size, from plain words."""
    words_of = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x) for x in (t or "").lower().split()) if w]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    held = {i: words_of(t) for i, t in items}
    held = {i: w for i, w in held.items() if w}
    df = Counter(g for w in held.values() for g in grams(w, min(5, len(w))))
    weight = lambda g: 1 + math.log((1 + len(held)) / (1 + df.get(g, 1)))
    out = {}
    for d, t in docs:
        own = words_of(t)
        for i, w in held.items() if own else ():
            n, theirs = len(w), grams(w, min(5, len(w)))
            for at in range(max(1, len(own) - n + 1)):
                mine = grams(own[at : at + n], min(5, n))
                total = lambda c: sum(v * weight(g) for g, v in c.items())
                similarity = total(mine & theirs) / total(mine | theirs)
                if similarity >= 0.8 and similarity > out.get((d, i), (0,))[0]:
                    out[d, i] = (similarity, at)
    return out


def test_leaks_equal_an_exhaustive_search(spark):
    """Items of many sizes in documents, whole, changed in the middle, cut, repeated, or near another item."""
    rng, items, docs = random.Random(12), [], []
    for i in range(14):
        items.append((i, sentence(4 + 4 * i, 900 + i)))
    items.append((14, " ".join([*items[9][1].split()[:-1], "else"])))
    for i, t in items:
        for change in range(4):
            words = t.split()
            if change == 1:
                words[rng.randrange(len(words))] = "changed"
            elif change == 2:
                words = words[1:]
            elif change == 3:
                words[-1:] = ["x", "y"]
            docs.append((len(docs), " ".join([sentence(rng.randrange(40), 50 + len(docs)), *words, sentence(rng.randrange(40), 150 + len(docs))])))
    docs += [(len(docs), items[5][1] + " " + items[5][1]), (len(docs) + 1, None), (len(docs) + 2, "")]
    want = exhaustive_leaks(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (50, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontaminate.op1_simhash_windows(df, bench).collect()}
    assert len(want) > 40 and set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-5) for k in want)
    # Fingerprints within the radius are found whatever bits differ.
    bits = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    for one in bits:
        other = one
        for b in rng.sample(range(64), decontaminate.RADIUS):
            other ^= np.uint64(1 << b)
        near = decontaminate.blocks_of(np.array([one])) ^ decontaminate.blocks_of(np.array([other]))
        assert min(int(x).bit_count() for x in near[0]) <= decontaminate.RADIUS // decontaminate.BLOCKS


def test_clashing_columns(spark):
    """Extra columns bear the names that operators use inside; stages return the documents' columns."""
    names = "_id _digest digest row shard slot path bucket node label band value key keep batch block item"
    texts = [sentence(60, 31), sentence(60, 32), None, ""]
    df = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df = df.select("*", *(F.lit(7).alias(n) for n in names.split()))
    bench, labels = spark.createDataFrame([(0, texts[1])], "item_id long, text string"), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for out, left in ((decontaminate.drop_leaked(df, bench), {0, 2, 3}), (near_dedup.keep_one(df), {0, 1, 2}), (quality_kn.keep_good(df, labels), {0, 1, 2, 3})):
        assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == left
    assert {r["doc_id"] for r in decontaminate.op1_simhash_windows(df, bench).collect()} == {1}
    assert near_dedup.op4_consistent_sampling(df).count() == quality_kn.op7_kneser_ney(df, labels).count() == attention_lm.op6_attention_scores(df, BPE).count() == 4
    assert packing.op3_drr_packing(df, BPE).count() == token_store.op10_simple8b(df, BPE).count() == media.op5_signature_sniffing(df).count() == 4
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>one two")], "page_id long, url string, html string").select("*", *(F.lit(7).alias(n) for n in (names + " host text n_chars rule verdict listed _key").split()))
    assert [r["text"] for r in html_consensus.op9_consensus_paths(pages).collect()] == ["one two"] and url_cascade.op8_url_cascade(pages).first()["verdict"] == "allow"


def test_null_and_repeated_ids(spark):
    item, a, b, c = sentence(30, 500), sentence(90, 61), sentence(90, 62), sentence(90, 63)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = spark.createDataFrame([(None, item), (None, a), (None, None), (3, item), (3, b), (4, c)], "doc_id long, text string")
    left = decontaminate.drop_leaked(df, bench).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(None, a), (None, None), (3, b), (4, c)])
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    df = spark.createDataFrame([(None, a), (5, a), (6, near(a, "x")), (7, b), (7, c), (None, near(c, "y")), (None, item), (None, item)], "doc_id long, text string")
    kept = near_dedup.keep_one(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, a), (7, b), (7, c), (None, item)])


def brute_kneser_ney(texts):
    """Probability function of an interpolated modified Kneser-Ney model over 4-grams of the same symbols."""
    grams = Counter()
    for t in texts:
        keys, _ = quality_kn.grams(*quality_kn.symbols([t])[:2])
        grams.update(int(k) for k in keys)
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(key & ((1 << 8 * k) - 1) for key in levels[k + 1])
    cuts = {}
    for k, c in levels.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        cuts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 for i in (1, 2, 3)]

    def p(key, k=4):
        if not k:
            return 1 / 256
        low = p(key & ((1 << 8 * (k - 1)) - 1), k - 1)
        context = {x: v for x, v in levels[k].items() if x >> 8 == key >> 8}
        if not context:
            return low
        d = lambda v: cuts[k][min(v, 3) - 1]
        total = sum(context.values())
        own = max(context[key] - d(context[key]), 0) / total if key in context else 0
        return own + sum(d(v) for v in context.values()) / total * low

    return p


def test_kneser_ney_equals_brute_force(spark, monkeypatch):
    train = [sentence(30, 700 + i) + "." for i in range(6)]
    model = quality_kn.train(spark.createDataFrame([(t,) for t in train], "text string"))
    p = brute_kneser_ney(train)
    asked = sorted({int(k) for k in quality_kn.grams(*quality_kn.symbols([train[0], "zq the then $$$ the the the", ""])[:2])[0]})
    got = {r["key"]: r["logp"] for r in quality_kn.resolve(spark.createDataFrame([(k,) for k in asked], "key long"), model).collect()}
    assert all(got[k] == pytest.approx(math.log10(p(k)), abs=1e-6) for k in asked)


def test_perplexity_and_keep_equal_brute_force(spark, monkeypatch):
    """Every document's perplexity, each symbol by itself, and the thresholds, by sorting."""
    monkeypatch.setattr(quality_kn, "HEAD_BITS", 6)  # so that both the table and the join count
    monkeypatch.setattr(quality_kn, "LEAST", 5)
    rows = [(i, sentence(12, 600 + i), ["en", "el"][i % 2]) for i in range(40)]
    rows = [(i, t.translate({97 + k: 0x3B1 + k for k in range(24)}) if g == "el" else t, g) for i, t, g in rows]
    rows += [(50, "the the the thing", "en"), (51, None, "en"), (52, "zz $$$ zz", None), (53, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sample = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2))).collect()}
    p = brute_kneser_ney([t for i, t, _ in rows if sample.get(i) == 0])
    nll, size, seen = {}, {}, {}
    for i, t, _ in rows:
        sym, n, weight = quality_kn.symbols([t or ""])
        keys = quality_kn.grams(sym, n)[0].tolist()
        for k in keys:
            seen.setdefault(k, math.log10(p(k)))
        nll[i], size[i] = -sum(seen[k] * w for k, w in zip(keys, weight[3:].tolist())), int(weight[3:].sum())
    assert size[50] == len("the the the thing") + 1
    got = {r["doc_id"]: r for r in quality_kn.op7_kneser_ney(docs, labels).collect()}
    calm = {g: [i for i, _, x in rows if x == g and sample.get(i) == 1] for g in ("en", "el")}
    mean = {g: sum(nll[i] for i in ids) / sum(size[i] for i in ids) for g, ids in calm.items()}
    every = [i for ids in calm.values() for i in ids]
    steady = lambda i, m: (nll[i] + quality_kn.PRIOR * m) / (size[i] + quality_kn.PRIOR)
    rank = lambda values: sorted(values)[math.ceil(quality_kn.QUANTILE * len(values)) - 1]
    limit = {g: rank([steady(i, mean[g]) for i in ids]) if len(ids) >= 5 else None for g, ids in calm.items()}
    overall = rank([steady(i, mean[g]) for g, ids in calm.items() for i in ids])
    for i, _, g in rows:
        m = mean.get(g, sum(nll[x] for x in every) / sum(size[x] for x in every))
        assert math.log10(got[i]["perplexity"]) == pytest.approx(nll[i] / size[i], abs=1e-4)
        assert math.log10(got[i]["threshold"]) == pytest.approx(limit.get(g) or overall, abs=1e-4)
        if size[i] > 1 and abs(steady(i, m) - (limit.get(g) or overall)) > 1e-5:
            assert got[i]["keep"] == (steady(i, m) <= (limit.get(g) or overall)), i
    assert not got[52]["keep"] and got[51]["keep"]


def test_quality_keeps_clean(spark):
    clean = [(i, sentence(80, 800 + i), "en") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in sentence(80, 900 + i).split()), "en") for i in range(20)] + [(2000, "thing " * 300, "en")]
    docs = spark.createDataFrame([*clean, *junk, (3000, None, None), (3001, "", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    keep = {r["doc_id"]: r["keep"] for r in quality_kn.op7_kneser_ney(docs, labels).collect()}
    assert len(keep) == len(clean) + len(junk) + 2 and keep[3000] and keep[3001]
    assert sum(keep[i] for i in range(200)) >= 195 and not any(keep[i] for i in range(1000, 1020)) and not keep[2000]
    assert quality_kn.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality_kn.op7_kneser_ney(docs.limit(0), labels).count() == 0


def test_all_trusted_documents_count(spark):
    """Every document labelled good trains the model or gives thresholds, above any number that was once enough."""
    n = 20_400
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2))).collect()}
    seen, real = [], quality_kn.train

    def watched(texts):
        seen.append({r["text"] for r in texts.select("text").collect()})
        return real(texts)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_kn, "train", watched)
        rows = quality_kn.op7_kneser_ney(docs, labels).collect()
    assert len(rows) == n and seen == [{f"w{i}" for i in range(n) if half[i] == 0}]


def test_quality_works_in_small_memory(monkeypatch):
    """Counting and scoring 3 MB of text take some 20 times the memory of a piece, not of a batch; pieces change no count."""
    texts = [sentence(400, g) for g in range(1000)]
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["x"] * 1000), pa.array(range(1000)), pa.array(texts)], names=list("abcd"))
    held = type("Held", (), {"value": (np.zeros(1 << 20, np.int64) - 1, np.zeros(1 << 20, np.float32))})()
    monkeypatch.setattr(quality_kn.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for work in (lambda: quality_kn._counts(iter([batch.select(["d"])])), lambda: quality_kn._score(iter([batch]), held)):
        tracemalloc.start()
        for _ in work():
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, peak
    want, got = Counter(quality_kn.grams(*quality_kn.symbols(texts)[:2])[0].tolist()), Counter()
    for b in quality_kn._counts(iter([batch.select(["d"])])):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == want


def test_attention_step_in_parts(monkeypatch):
    """A step's loss and gradients are the same in parts of any size, and its memory is a part's, not the lot's."""
    rng, m, n = np.random.default_rng(4), attention_lm.Attention(np.zeros(attention_lm.CLASSES, np.float32)), attention_lm.LOT
    x, y = rng.integers(0, 50, (2, n, attention_lm.WINDOW)), rng.integers(0, attention_lm.CLASSES, (n, attention_lm.STRIDE))
    w = (rng.random(y.shape) < 0.9).astype(np.float32)
    tracemalloc.start()
    loss, g = m.step(x, y, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak
    for rows in (7, n):
        monkeypatch.setattr(attention_lm, "STEP_ROWS", rows)
        other, h = m.step(x, y, w)
        assert other == pytest.approx(loss, rel=1e-4) and g.keys() == h.keys() == m.p.keys()
        assert all(np.allclose(g[k], h[k], rtol=1e-2, atol=1e-4 * np.abs(g[k]).max()) for k in g)


def test_attention_gradients():
    m = attention_lm.Attention(np.zeros(attention_lm.CLASSES, np.float32))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 50, (2, 3, attention_lm.WINDOW)), rng.integers(0, 50, (3, attention_lm.STRIDE))
    w = (rng.random(y.shape) < 0.8).astype(float)
    _, g = m.step(x, y, w)
    for name in m.p:
        i = tuple(rng.integers(0, min(40, s)) for s in m.p[name].shape)
        old = m.p[name][i]
        m.p[name][i] = old + 1e-5
        up = m.step(x, y, w)[0]
        m.p[name][i] = old - 1e-5
        down = m.step(x, y, w)[0]
        m.p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_rounds_learn_from_every_window_once(spark, monkeypatch):
    """All windows of all training texts, and no other, are stepped on, each in one round."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(9)}" for _ in range(3 + 31 * i % 400))) for i in range(60)], "doc_id long, text string")
    corpus = attention_lm.read_corpus(docs, BPE)
    streams = [b for b in corpus.streams.select("held", "sizes", "klass", "rows").toArrow().to_batches() if b.num_rows]
    key = lambda x, y: [a.tobytes() + b.tobytes() for a, b in zip(np.ascontiguousarray(x.transpose(1, 0, 2)), y)]
    want, got, step = Counter(), Counter(), attention_lm.Attention.step
    for b in streams:
        for i in range(b.num_rows):
            want.update(key(*attention_lm.lessons(b, i)[:2]))
    assert want.total() == sum(-(-(3 + 31 * i % 400 + 1) // attention_lm.STRIDE) for i in range(60) if not attention_lm.is_held_out(i))

    def watched(self, x, target, weight):
        got.update(key(x, target))
        return step(self, x, target, weight)

    monkeypatch.setattr(attention_lm.Attention, "step", watched)
    monkeypatch.setattr(attention_lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    held = type("Held", (), {"value": (corpus.prior, attention_lm.Attention(corpus.prior).raw())})()
    for turn in range(attention_lm.ROUNDS):
        list(attention_lm._trained(iter(streams), held, turn))
    assert got == want


def test_windows_score_each_place_once():
    sizes = np.array([1, 0, 16, 17, 40, 5])
    before, own = attention_lm.windows(sizes)
    assert sorted(own[own >= 0].tolist()) == list(range(sizes.sum()))
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for b, o in zip(before, own):
        for k, at in enumerate(o.tolist()):  # the last places read are those before the ones scored
            if at >= 0:
                want = [p if p >= begin[at] else -1 for p in range(at - (attention_lm.WINDOW - attention_lm.STRIDE) - k - 1, at)]
                assert b[: len(want)].tolist() == want


def test_windows_share_what_they_read():
    """Windows along a run of places give the states that each gives by itself."""
    w, t, rng = attention_lm.WINDOW, attention_lm.STRIDE, np.random.default_rng(2)
    m, rows = attention_lm.Attention(np.zeros(attention_lm.CLASSES, np.float32)), rng.integers(0, 2 * attention_lm.BUCKETS, (2, w + 5 * t)).astype("<u2")
    alone = m.forward(np.stack([rows[:, a : a + w] for a in range(0, 5 * t + 1, t)], axis=1))
    assert np.allclose(m.states(rows), alone, atol=1e-5)


def test_words_travel_in_few_rows():
    """A row for each bucket of a batch's words, not for each word; equal words meet, with the sums of all batches."""
    texts = pa.array([" ".join(f"w{i}é" for i in range(3000)), " ".join(f"w{i}é" for i in range(1000, 5000)), "", None])
    task, topics = attention_lm.TaskContext.get, attention_lm.find_topics(texts)
    attention_lm.TaskContext.get = lambda: type("Task", (), {"partitionId": lambda self: 0})()
    try:
        own = [list(attention_lm._batches(iter([pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), texts.slice(k, 1)], names=["k", "t"])]), topics))[0] for k in range(4)]
    finally:
        attention_lm.TaskContext.get = task
    own = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), b["packed"], b["n_words"], b["counts"]], names=["batch", "packed", "n_words", "counts"]) for k, b in enumerate(own)]
    listed = [b for b in attention_lm._listed(iter(own), 16)]
    assert len(listed) == 2 and all(b.num_rows <= 16 for b in listed)
    got = pa.Table.from_batches(attention_lm._spelled(iter(listed), BPE)).to_pydict()
    trained = [not attention_lm.is_held_out(k) for k in range(2)]
    assert dict(zip(got["word"], got["count"])) == {f"w{i}é": trained[0] * (i < 3000) + trained[1] * (i >= 1000) for i in range(5000)}
    places = {w: [r["of"] for r in np.frombuffer(p, attention_lm.PLACES)] for w, p in zip(got["word"], got["places"])}
    assert places["w0é"] == [0] and places["w2000é"] == [0, 1] and places["w4000é"] == [1]


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_words_of():
    texts = ["skip me", *TEXTS, "A\x0bB\x1cC É", " lead", "x "]
    flat, sizes = attention_lm.words_of(pa.array(texts).slice(1))
    want = [split_words(t) for t in texts[1:]]
    assert flat.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(w) for w in want]


def brute_class_score(p, rows, target):
    """log10 of the class probability of each token of a text, one at a time."""
    w, s, total = attention_lm.WINDOW, attention_lm.STRIDE, 0.0
    p = {k: v.astype(np.float64) for k, v in p.items()}
    for t in range(len(target)):
        k = w - s + t % s  # its place in its window
        past = [rows[t - k + j - 1] if t - k + j > 0 else (2 * attention_lm.BUCKETS,) * 2 for j in range(k + 1)]
        e = [p["emb"][a] + p["emb"][b] + p["pos"][j] for j, (a, b) in enumerate(past)]
        q = e[-1] @ p["q"] / math.sqrt(attention_lm.WIDTH)
        a = np.exp([q @ (x @ p["k"]) for x in e])
        seen = sum(y * (x @ p["v"]) for x, y in zip(e, a)) / a.sum()
        y = e[-1] + np.maximum(e[-1] @ p["own"] + seen @ p["seen"] + p["b"], 0) @ p["down"]
        z = y @ p["out"] + p["bias"]
        total += (z[target[t]] - np.log(np.exp(z).sum())) / math.log(10)
    return total


def test_scores(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(attention_lm, "START_STEPS", 30)
    monkeypatch.setattr(attention_lm, "HEAD", 5)
    monkeypatch.setattr(attention_lm, "STREAM_TOKENS", 300)
    monkeypatch.setattr(attention_lm, "train", lambda streams, prior, own=attention_lm.train: models.append(own(streams, prior)) or models[-1])
    texts, models = [*TEXTS, "zzqx unheard-of,", sentence(30, 77)], []
    while not attention_lm.is_held_out(len(texts) - 2):
        texts.insert(0, sentence(10, len(texts)))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in attention_lm.op6_attention_scores(df, BPE).collect()}
    assert len(got) == len(texts)
    words = {i: split_words(t) for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = Counter(w for i, ws in words.items() if not out[i] for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    corpus = attention_lm.read_corpus(df, BPE)
    enc = bpe.encoder(BPE)
    for i, ws in words.items():
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws) + 1, sum(w in count for w in [*ws, None]), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    # The score is the context's part, computed token by token, and each word's part in its class.
    streams = {}
    for r in corpus.streams.collect():
        at, flat = 0, np.frombuffer(r["rows"], "<u2").reshape(2, -1).T.tolist()
        for key, size, inside in zip(r["keys"], r["sizes"], r["inside"]):
            streams[key] = (flat[at : at + size], list(r["klass"][at : at + size]), inside)
            at += size
    for i, (read, klass, inside) in streams.items():
        assert klass[-1] == attention_lm.END and got[i]["score"] == pytest.approx(brute_class_score(models[0].p, read, klass) + inside, rel=1e-4)
        for w, (a, b) in zip(words[i], read):
            ids = enc.whole.encode(" " + w, add_special_tokens=False).ids
            assert (a, b) == (corpus.words.row[ids[0]], corpus.words.row[ids[-1]] + attention_lm.BUCKETS)
    assert attention_lm.op6_attention_scores(empty, BPE).count() == 0


def test_shares_and_spellings():
    """Known words' shares in their groups leave what unknown ones may have; spellings follow the counts of pairs."""
    words = pa.array(["ab", "abc", "abd", "xy", "ab.", "zz"])
    count, topic = np.array([5, 1, 2, 1, 3, 0]), np.zeros(6, np.int64)
    ids, n = np.array([0, 0, 2, 0, 3, 4, 0, 5, 4, 4]), np.array([1, 2, 2, 1, 2, 2])
    batch = pa.RecordBatch.from_arrays([words, pa.array(count), pa.array(topic), pa.ListArray.from_arrays(pa.array([0, *np.cumsum(n)], pa.int32()), pa.array(ids))], names=["word", "count", "topic", "ids"])
    found = [b.to_pydict() for b in attention_lm._statistics(iter([batch]), pa.array(["xy"], pa.string()), 6)]
    kind, key, number = (np.array([x for f in found for x in f[c]]) for c in ("kind", "key", "n"))
    pair = kind == attention_lm.PAIR
    assert dict(zip(key[pair].tolist(), number[pair].tolist())) == {0 * 7 + 6: 1, 0 * 7 + 2: 1, 2 * 7 + 6: 1, 0 * 7 + 3: 1, 3 * 7 + 6: 1, 4 * 7 + 6: 1, 0 * 7 + 5: 1, 5 * 7 + 6: 1}
    w = attention_lm.Words(pa.array(["xy"], pa.string()), (kind, key, number), (key[pair], number[pair]), 6)
    klass, a, b, inside = w.features(words, count, topic, ids, n)
    assert klass[3] == 0 and inside[3] == 0 and klass[0] == klass[1] == klass[2] == attention_lm.GROUPS + 2 and klass[4] == attention_lm.GROUPS
    novel = (1 + 0.5) / (8 + 1)
    spelled = 10 ** w.spelled(ids, n).max(axis=1)
    assert 10 ** inside[:3] == pytest.approx((1 - novel) * count[:3] / 8 + novel * 10 ** w.spelled(ids, n)[:3, 0])
    # After id 0 stand four different ids, each once: each keeps a half, and the other halves go by the topic's shares.
    later = w.later[:, 0]
    assert 10 ** w.spelled(ids, n)[1, 0] == pytest.approx(w.first[0, 0] * (0.5 / 4 + 0.5 * later[2]) * (0.5 + 0.5 * later[6]), rel=1e-5)
    assert sum(10 ** w.spelled(np.array([0, k, 0])[[0, 1]], np.array([2]))[0, 0] for k in range(6)) < 1 and (spelled < 1).all()


def test_pipeline_stages(spark, tmp_path):
    """Each stage works on what the one before it kept; junk, near copies and leaks go; all ids are packed."""
    import corpus_pipeline

    item, near = sentence(30, 500), lambda t: " ".join([*t.split()[:-1], "else"])
    clean = [(i, sentence(80, 800 + i)) for i in range(120)]
    copies = [(200 + i, near(clean[i][1])) for i in range(10)] + [(220, clean[3][1])]
    junk = [(300 + i, " ".join(w + "$$$" for w in sentence(80, 900 + i).split())) for i in range(5)]
    leaks = [(400, sentence(40, 77) + " " + item + " " + sentence(40, 78))]
    rows = [*clean, *copies, *junk, *leaks, (500, None), (None, sentence(70, 79))]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen[name] = {r["doc_id"] for r in now.collect()}
    kept = {i for i, _ in clean} | {500, None}
    dropped = kept - seen["quality classifier"]
    assert len(dropped) <= 2 and not seen["quality classifier"] & {i for i, _ in junk}
    assert not (seen["near-dedup"] & {i for i, _ in copies} - {200 + i for i in dropped if i} - {220}) and 400 in seen["near-dedup"]
    assert seen["decontamination"] == seen["near-dedup"] - {400}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    texts, tk = dict(rows), Tokenizer.from_file(BPE)
    held = Counter()
    for r in pieces:
        held[r["doc_id"]] += r["length"]
    assert held == {i: len(tk.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in seen["decontamination"]}


def test_topics_and_spellings_are_of_all_training_texts(spark, monkeypatch):
    """Texts beyond the sample move topics; anchors are counted over all; pairs that tasks don't hold count as all others do."""
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}" for a in ("stra", "klo", "whe") for b in ("ngen", "ister", "lm") for c in ("en", "ing", "ed", "zq", "xw")]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 3 * 15 : i % 3 * 15 + 15], 40)) + f" only{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    monkeypatch.setattr(attention_lm, "SAMPLE_DOCS", 3)
    monkeypatch.setattr(attention_lm, "BATCH_BYTES", 2000)
    monkeypatch.setattr(attention_lm, "ANCHORS", 30)
    found, moved = [], attention_lm.moved
    monkeypatch.setattr(attention_lm, "moved", lambda batches, topics: found.append((topics, moved(batches, topics))) or found[-1][1])
    corpora = []
    for pairs, first in ((1 << 19, 4096), (5, 8)):
        monkeypatch.setattr(attention_lm, "PAIRS", pairs)
        monkeypatch.setattr(attention_lm, "LISTED_FIRST", first)
        corpora.append({k: v for r in attention_lm.read_corpus(df, BPE).streams.collect() for k, v in zip(r["keys"], r["inside"])})
    assert corpora[0].keys() == corpora[1].keys() == set(range(60)) and all(corpora[1][k] == pytest.approx(v, rel=1e-5) for k, v in corpora[0].items())
    train = [t for i, t in rows if not attention_lm.is_held_out(i)]
    count = Counter(w for t in train for w in split_words(t))
    want = sorted(count, key=lambda w: (-count[w], w))[:30]
    assert len(found) == 2 * attention_lm.PASSES
    for before, after in found:
        assert before.anchors.to_pylist() == want
        flat, sizes = attention_lm.words_of(pa.array(train))
        coded = flat.dictionary_encode()
        x = before.profiles(coded.dictionary, coded.indices.to_numpy(), sizes)
        own = np.argmax(x @ before.centres.T, axis=1)
        for z in range(attention_lm.TOPICS):
            mean = x[own == z].sum(axis=0) if (own == z).any() else before.centres[z]
            assert np.allclose(after.centres[z], mean / max(np.linalg.norm(mean), 1e-9))
