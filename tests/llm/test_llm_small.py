"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tempora.llm import decontaminate, fingerprint, jaccardjoin, langid, mainpage, packing, phrasededup, sharding, suffixdedup, tokencount

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ly", "er", "ing", "é"]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = prose(rng, 60)
    base = prose(rng, 150)
    near = base.split()
    near[3], near[70] = "changed", "words"
    texts = [None, "", "   ", "a", "one two three", base, base, " ".join(near), shared + ". " + prose(rng, 80), prose(rng, 20) + "\n" + shared, "x" * 700, "ab" * 400, prose(rng, 4000), "na na na na na " * 60, "über straße\tund\nmehr " * 3, "́ combining \x1c odd   blanks"]
    texts += [prose(rng, rng.randrange(1, 90)) for _ in range(25)]
    rows = [(i, t, "en" if t else None, "s", len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[8], (None, "a row without a key", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("label", "node", "start", "score", "n_removed", "N_bytes", "n_words", "n_tokens", "lang_pred", "group", "item", "size", "shard")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_removed(items, width):
    count = Counter(tuple(x[i : i + width]) for x in items for i in range(len(x) - width + 1))
    out = []
    for x in items:
        mask = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if count[tuple(x[i : i + width])] > 1:
                mask[i : i + width] = b"\1" * width
        out.append(mask)
    return out


def key_of(row):
    return tuple((v is None, v) for v in row)


def test_suffix_dedup(docs, empty):
    rows = corpus()
    items = [(r[1] or "").encode() for r in rows]
    expected = []
    for r, x, mask in zip(rows, items, brute_removed(items, 200)):
        kept = bytes(c for c, m in zip(x, mask) if not m)
        expected.append((r[0], len(x), sum(mask), len([s for s in bytes(mask).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    got = suffixdedup.removals(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(key_of, got)) == sorted(map(key_of, expected))
    assert sum(e[2] for e in expected) > 2000
    assert suffixdedup.removals(empty).count() == 0
    kept = {r.doc_id: r.text for r in suffixdedup.removals(docs, keep_text=True).collect()}
    assert kept[0] is None and kept[10] == "" and kept[12] == corpus()[12][1]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for alphabet, n in ((2, 300), (3, 1000), (256, 500), (1, 90), (2, 1), (5, 0)):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        raw = data.tobytes()
        order = suffixdedup.suffix_array(data, n + 1)
        expected = sorted(range(n), key=lambda i: raw[i:])
        assert order.tolist() == expected
        wanted = rng.random(n) < 0.3
        some = suffixdedup.suffix_array(data, n + 1, wanted)
        assert some.tolist() == [i for i in expected if wanted[i]]
        for k, length in enumerate(suffixdedup.common_prefixes(data, some, n + 1).tolist()[1:]):
            a, b = raw[some[k] :], raw[some[k + 1] :]
            assert length == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        lengths = suffixdedup.common_prefixes(data, order, n + 1).tolist()
        for k in range(1, n):
            a, b = raw[expected[k - 1] :], raw[expected[k] :]
            assert lengths[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_phrase_dedup(docs, empty):
    rows = corpus()
    items = [(r[1] or "").encode().split() for r in rows]
    expected = []
    for r, x, mask in zip(rows, items, brute_removed(items, 35)):
        kept = b" ".join(w for w, m in zip(x, mask) if not m)
        expected.append((r[0], len(x), sum(mask), hashlib.sha256(kept).hexdigest()))
    got = phrasededup.removals(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(key_of, got)) == sorted(map(key_of, expected))
    assert phrasededup.removals(empty).count() == 0


@pytest.mark.parametrize("hot,chunk", [(1, 300), (3, 1 << 20)])
def test_repeats_with_hot_anchors_and_pieces(spark, monkeypatch, hot, chunk):
    """Hot anchors are divided and long texts worked on in pieces without a change of the result."""
    from tempora.llm import repeats

    rng = random.Random(3)
    base = prose(rng, 120).split()
    texts = []
    for i in range(12):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edit%d" % i
        texts.append(prose(rng, i) + " " + " ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(repeats, "HOT", hot)
    for width, operator, items in ((60, suffixdedup.removals, [t.encode() for t in texts]), (12, phrasededup.removals, [t.encode().split() for t in texts])):
        expected = {i: sum(m) for i, m in enumerate(brute_removed(items, width))}
        assert {r.doc_id: r.n_removed for r in operator(docs, width).collect()} == expected
    kind = suffixdedup.byte_kind(60)
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    values, offsets, _, _ = kind.items(data, np.array([0, len(data)]))
    whole = repeats.runs(values, offsets, 60, kind.k)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    parts = repeats.runs(values, offsets, 60, kind.k)
    spread = lambda r: {(s, h) for f, l, _, h in zip(*(x.tolist() for x in r)) for s in range(f, l + 1)}
    assert spread(whole) == spread(parts) and len(spread(whole)) == len(data) - 59


def brute_classes(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * common >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return links, [find(i) for i in range(len(rows))]


def test_jaccard_join(docs, empty, monkeypatch):
    rows = corpus()
    links, group = brute_classes(rows)
    ids = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    expected = sorted(key_of((r[0], ids[g], n)) for r, g, n in zip(rows, group, links))
    for block in (1024, 1):
        monkeypatch.setattr(jaccardjoin, "BLOCK", block)
        got = jaccardjoin.similarity_classes(docs).select("doc_id", "class_id", "n_links").collect()
        assert sorted(map(key_of, got)) == expected
    assert sum(links) > 0 and jaccardjoin.similarity_classes(empty).count() == 0
    kept = jaccardjoin.keep_one(docs)
    assert kept.columns == docs.columns
    blank = sum(not (r[1] or "").strip() for r in rows)
    assert kept.count() == len({g for g, r in zip(group, rows) if (r[1] or "").strip()}) + blank
    assert jaccardjoin.keep_one(empty).count() == 0


def test_equal_sets_are_one_node_wherever_they_stand(spark):
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(40)]
    rows = [(i, texts[i % 40] if i % 2 else " ".join(texts[i % 40].split())) for i in range(400)]
    docs = spark.createDataFrame(rows, "__id long, __text string").withColumns({"__h": F.lit(0).cast("long"), "__h2": F.lit(0).cast("long")})
    assert jaccardjoin.sets_of(docs.repartition(3), 5).select("__a", "__b").distinct().count() == 40


def test_pruning_bound_and_both_ways_of_counting():
    fewest = jaccardjoin.least_matches(0.8, 1e-9)
    assert all(0 <= fewest[n] < 0.8 * n for n in range(16, 97, 16)) and fewest[96] > fewest[48] > fewest[16]
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.sort(rng.choice(pool, 150 + i % 7, replace=False)) for i in range(30)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sign = jaccardjoin.signatures(np.concatenate(sets), offsets)
    every = np.arange(30)
    i, j = np.triu_indices(30, 1)
    truth = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (jaccardjoin._common(sets, every, i, j) == truth).all()
    left, right = jaccardjoin.linked_pairs(sets, sign, every, every, 0.5, 1e-9)
    size = np.array([len(s) for s in sets])
    assert {*zip(left.tolist(), right.tolist())} <= {(a, b) for a, b, c in zip(i.tolist(), j.tolist(), truth.tolist()) if 2 * c >= size[a] + size[b] - c}


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    item = prose(rng, 30) + "."
    words = item.rstrip(".").split()
    edited = list(words)
    edited[4], edited[17] = "swapped", "other"
    del edited[25]
    texts = [prose(rng, 40) + " " + item.upper() + " " + prose(rng, 10), prose(rng, 200) + "\n" + ", ".join(edited), prose(rng, 60), " ".join(words[:8]) + " " + prose(rng, 30), None, ""]
    table = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)] + [(0, texts[0], 1.0)], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "two words"), (4, None), (5, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.score, 3)) for r in decontaminate.contaminated(table, bench).collect())
    assert [g[:2] for g in got] == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 2)]
    assert got[0][2] == 1.0 and 0.7 < got[-1][2] < 1
    left = decontaminate.clean(table, bench)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_an_edited_copy_is_found_however_many_exact_ones_there_are(spark):
    item = [f"w{k}" for k in range(18)]
    edited, loose = list(item), []
    edited[4], edited[12] = "other", "changed"
    for k, w in enumerate(item):  # a word put in after every second one: no three words of the item stand together
        loose += [w] + (["put"] if k % 2 and k < 17 else [])
    rows = [(k, f"copy {k} has " + " ".join(item) + " in it") for k in range(1500)] + [(1500, "one has " + " ".join(edited)), (1501, " ".join(loose)), (1502, " ".join(item[:8]))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == set(range(1502)) and round(got[1500], 2) == 0.78 and got[1501] == 10 / 18


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(0, 12)), rng.integers(0, 6, rng.integers(0, 15))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_sharding(docs, empty):
    rows = corpus()
    got = sharding.shard(docs, shards=4).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.size, r.text_crc32) for r in got) == sorted(((r[0] is None, r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = {}
    for r in got:
        texts.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert max(map(len, texts.values())) == 1  # no group is large here, so none is split
    assert sharding.shard(empty).count() == 0


def test_sharding_balances_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(i, "the same text " * 20 if i % 3 == 0 else prose(rng, rng.randrange(5, 300))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, cell_rows=1500).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 16 and max(r.b for r in got) < 1.01 * min(r.b for r in got) and max(r.n for r in got) < 1.05 * min(r.n for r in got)


def edited_text(texts, k):
    text, follow = texts[k], texts[(k + 1) % len(texts)]
    half = len(text) // 2
    return text[: len(text) - half] + follow[:half]


def test_fingerprints(spark, docs, empty):
    rows = sorted({r[0]: r for r in corpus() if r[0] is not None}.values())
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(table).collect()}
    texts = [r[1] or "" for r in rows]
    assert len(got) == len(rows)
    for k, text in enumerate(texts):
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256(edited_text(texts, k).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        assert (got[k].fingerprint == got[(k + 1) % len(texts)].fingerprint) == (got[k].near_next == 1)
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0
    assert fingerprint.document_fingerprints(docs).count() == docs.count()
    assert fingerprint.document_fingerprints(empty).count() == 0


def test_fingerprints_are_sums(spark):
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b")], "k long, u string")
    made = {r.k: r.f for r in fingerprint.sums(parts, ["k"], "u").select("k", fingerprint.fingerprint().alias("f")).collect()}
    assert made[1] == made[2] != made[3]
    base, change = fingerprint.sums(parts.where("k = 3"), ["k"], "u"), fingerprint.sums(parts.where("k = 1").limit(0).unionByName(spark.createDataFrame([(3, "b")], "k long, u string")), ["k"], "u")
    grown = fingerprint.edit(base, change, ["k"])
    assert grown.select(fingerprint.fingerprint()).first()[0] == made[1]
    assert fingerprint.edit(grown, change, ["k"], -1).select(fingerprint.fingerprint()).first()[0] == made[3]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models

    pieces = tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known = Tokenizer(models.Unigram(pieces, 0, True))
    counter = tokencount.Counter(pieces)
    assert counter.parts and counter.bytes
    rows = tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        marked = (" " + text if text and text[0] != " " else text).replace(" ", "▁")
        assert r.n_tokens == (len(known.encode(marked).ids) if text else 0), r.doc_id
        assert (r.best_score, r.n_tokens) == (counter.viterbi(marked) if text else (0.0, 0))
    assert tokencount.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_ties_of_a_small_vocabulary():
    from tokenizers import Tokenizer, models

    rng = random.Random(0)
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bab", -3.0), ("▁a", -2.0), ("▁", -1.0)]
    known, counter = Tokenizer(models.Unigram(pieces, 0, False)), tokencount.Counter(pieces)
    for _ in range(300):
        text = "".join(rng.choice("ab▁zé") for _ in range(rng.randrange(1, 14)))
        assert counter.viterbi(text)[1] == len(known.encode(text).ids), text


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, lots of them, and say so at length here.</div><div id=wrap><div class="post"><h1>Head &amp; line</h1><p>First  para
graph with <b>bold</b> and <a href=x>a link</a>.<p>Second one, unclosed<br>and broken. %s</p><aside>Not this</aside></div>
<div class="comments"><p>I liked it very much, dear author, and so on and on and on.</p></div></div><form>Name <input></form><footer>&copy; us</footer>"""


def test_main_text(spark):
    body = "More words of the article follow here. " * 3
    text = mainpage.main_text(PAGE % body)
    assert text == "Head & line First para graph with bold and a link. Second one, unclosed and broken. " + body.strip()
    long = "<html><body><article>" + "<p>word word</p>" * 30000 + "</article></body></html>"
    rows = [(1, "u", PAGE % body), (2, "u", None), (3, None, ""), (4, "u", "<<<>< a < b </ p> &am &#65;"), (5, "u", long), (6, "u", "plain"), (6, "u", "plain"), (7, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = mainpage.extract(pages).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 2, 3, 4, 5, 6, 6, 7] and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[2] == by[3] == "" and by[5].count("word") == 60000 and by[6] == "plain" and by[7] == "deep"
    assert mainpage.extract(pages.limit(0)).count() == 0


def paragraphs(rng, n):
    return [prose(rng, 40) for _ in range(n)]


def as_html(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_a_sole_article_beside_denser_text_is_not_the_page():
    some = paragraphs(random.Random(1), 10)
    for teaser in ("<article><p>Buy it now.</p></article>", "<article>Buy it now.</article>", "<main><h2>Offer</h2><p>Buy it now.</p></main>"):
        text = mainpage.main_text(f"<html><body>{teaser}<div>{as_html(some)}</div></body></html>")
        assert " ".join(some) in text, teaser
        assert " ".join(some) in mainpage.main_text(f"<html><body>{teaser}{as_html(some)}</body></html>"), teaser
    page = "<html><body><div>Some site</div><%s><h1>T</h1>" + as_html(some) + "<p>Short.</p></%s><div>Imprint</div></body></html>"
    for name in ("article", "main"):
        assert mainpage.main_text(page % (name, name)) == " ".join(["T", *some, "Short."])
    assert mainpage.main_text(page % ("div", "div")) == " ".join(["T", *some, "Short."])
    assert mainpage.main_text("<body><div><article>Plain words of a note</article></div></body>") == "Plain words of a note"


def test_article_spread_over_several_children_of_body():
    rng = random.Random(2)
    one, two, three = paragraphs(rng, 5), paragraphs(rng, 5), paragraphs(rng, 4)
    links = "<div>" + "".join(f"<a href=/{k}>Link {k}</a> " for k in range(8)) + "</div>"
    whole = " ".join(["T", *one, "Short.", *two])
    body = f"<body>{links}<h1>T</h1><div>{as_html(one)}</div>{links}<p>Short.</p><div>{as_html(two)}</div><h3>More</h3>{links}<div>Imprint</div></body>"
    assert mainpage.main_text(body) == mainpage.main_text(f"<html><head><title>x</title></head>{body}</html>") == whole
    deep = f"<body><div><div><div>{as_html(one)}</div></div></div><section>{links}<div>{as_html(two)}</div></section><div>{as_html(three)}</div></body>"
    assert mainpage.main_text(deep).endswith(" ".join([*two, *three])) and mainpage.main_text(deep).startswith(" ".join(one))
    loose = f"<body><div>{as_html(one)}</div>{two[0]} <b>{two[1]}</b> {two[2]}<div>{as_html(three)}</div></body>"
    assert mainpage.main_text(loose) == " ".join([*one, *two[:3], *three])


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=256).collect()
    expected = Counter()
    total = 0
    for r in corpus():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], "<u4").tobytes()
            expected[(r[0], k // 256, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-total // 256) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_rounds_and_bounds(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, rng.randrange(1, 101)) for i in range(4000)], "id long, length long")
    rows = packing.pack(items, capacity=100, cell_items=150, slack=0, fan_in=4).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    sizes = np.array([r.length for r in rows])
    assert len(rows) == 4000 and max(fill.values()) <= 100 and len(fill) <= 1.01 * packing.lower_bound(sizes, 100) + 1
    for _ in range(30):
        some = np.array([rng.randrange(1, 21) for _ in range(7)])
        bins = packing.best_fit_decreasing(some, 20)[2]
        assert packing.lower_bound(some, 20) <= fewest_bins(tuple(some), 20) <= len(bins)


def test_cells_at_their_bound_are_done_and_no_cell_grows(spark, monkeypatch):
    rng = random.Random(7)
    seen, packer = [], packing.cell_packer

    def watched(length, capacity, level, *more):
        seen.append(level)
        return packer(length, capacity, level, *more)

    monkeypatch.setattr(packing, "cell_packer", watched)
    large = spark.createDataFrame([(i, rng.randrange(51, 90)) for i in range(3000)], "id long, length long")
    rows = packing.pack(large, capacity=100, cell_items=100, fan_in=4).collect()
    assert seen == [0] and len(rows) == len({r.sequence_id for r in rows}) == 3000 and all(r.certified for r in rows)
    # a bound that no cell reaches, and still none takes in many more items than it should
    monkeypatch.setattr(packing, "dual_function", lambda count, capacity: (np.zeros(capacity + 1, np.int64), 1))
    rows = packing.pack(large, capacity=100, cell_items=100, fan_in=4).collect()
    cells = Counter(r.sequence_id >> 28 for r in rows)
    assert len(rows) == len({r.id for r in rows}) == 3000 and max(cells.values()) < 600


def fewest_bins(sizes, capacity):
    best = len(sizes)

    def go(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= sizes[k]:
                go(k + 1, room[:i] + [room[i] - sizes[k]] + room[i + 1 :])
        go(k + 1, room + [capacity - sizes[k]])

    go(0, [])
    return best


def test_language(spark, docs, empty):
    rng = random.Random(6)
    nouns = {"en": WORDS, "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre".split(), "xx": "qz wq zk jx vq".split()}
    rows = [(i, " ".join(rng.choice(nouns[k]) for _ in range(40)), k) for i, k in enumerate(["en", "fr", "xx"] * 30)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "12 34 !!", None), (203, "le un dans que pour avec tout", None), (203, "le un dans que pour avec tout", None), (204, "the of and " * 5000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(5), "bits": F.lit(0)})
    model = langid.fit(table, ~langid.held_out())
    assert model.languages == ["en", "fr", "xx"]
    got = langid.identify(table.select("doc_id", "text"), model).collect()
    truth = {r[0]: r[2] for r in rows[:90]}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got if r.doc_id in truth)
    rest = {r.doc_id: r.lang_pred for r in got if r.doc_id >= 200}
    assert rest == {200: "und", 201: "und", 202: "und", 203: "fr", 204: "en"}
    assert len(got) == len(rows)
    nothing = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.keep_languages(empty).count() == 0
    kept = langid.keep_languages(docs)
    assert kept.columns == docs.columns and kept.select("score").distinct().collect()[0][0] == 1


def test_stages_on_awkward_tables(spark, docs, empty):
    import corpus_pipeline

    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, table, "/root/testdata/sf0.001")
            assert left.columns == table.columns and left.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").count() >= table.count()


def test_language_code_lengths():
    """Tables and searches give the escape recurrence of the statistics."""
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abc ", np.uint8), 400)
    gram, _ = langid.grams(data, np.array([0, 400]))
    values, n = np.unique(gram, return_counts=True)
    model = langid.Model([("l", int(v), int(c)) for v, c in zip(values, n)])
    seen = Counter(gram.tolist())

    def bits(g, size):
        if not size:
            return 8.0
        mask = (1 << 8 * size) - 1
        after = Counter()
        for v, c in seen.items():
            if (v & mask) >> 8 == (g & mask) >> 8:
                after[v & 255] += c
        if not after:
            return bits(g, size - 1)
        total = sum(after.values()) + len(after)
        if after[g & 255]:
            return -np.log2(after[g & 255] / total)
        return -np.log2(len(after) / total) + bits(g, size - 1)

    asked = np.concatenate([gram[:40], rng.integers(0, 1 << 32, 40).astype(np.uint32), gram[:20] ^ np.uint32(1)])
    expected = [bits(int(g), 4) for g in asked]
    assert np.allclose(model.score(asked)[:, 0], expected) and np.allclose(langid.Tables(model).score(asked)[:, 0], expected, atol=1e-4)
