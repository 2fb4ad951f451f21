"""Vector codes, byte-level BPE and Merkle manifests on awkward tables, against brute force and the tokenizer library."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tempora.llm import bytebpe, common, covertree, merkle, tokencount

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHING = ("ids", "decoded", "n", "word", "block", "leaf", "root", "path", "g", "k", "digest", "pos", "nodes", "items", "n_tokens", "code", "error", "keys", "points")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})


def texts():
    rng = random.Random(3)
    odd = [chr(0x0558), chr(0x11DE0) + " ", "₏₞ x", "x　 \x1c\x85y"]
    out = [None, "", " ", "\n\n  a", "don't we'll  you", "naïve Über-straße 123,456", "x" * 3000, "é" * 999, "  ".join("ab" * 5), "日本語のテキスト。", "👩‍👩‍👧 emoji", *odd]
    out.append("".join(odd) * 40 + " end")
    out += [" ".join(rng.choice(["the", "of", "tokenization", "été", "42", "—", "\t", "Wörter"]) for _ in range(rng.randrange(1, 80))) for _ in range(20)]
    return out + ["the word " * 200_000, out[5]]


def test_byte_bpe(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no key"), (3, "again 3")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks(PATH), special_tokens={})
    coded = bytebpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = bytebpe.decode(coded, PATH).collect()
    expected = sorted((str(k), np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == expected
    digests = bytebpe.document_codes(docs, PATH, public_tokenizers.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, digests.collect())) == sorted(f"Row(doc_id={k}, n_tokens={len(i) // 4}, ids_sha256='{hashlib.sha256(i).hexdigest()}', decoded_sha256='{hashlib.sha256(t).hexdigest()}')" for k, i, t in expected)


def test_packed_numbers():
    for numbers in ([], [0], [255, 256], [1 << 16, 3], [2**32 - 1, 0, 70000]):
        assert bytebpe.unpack(bytebpe.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_byte_bpe_of_many_blocks_and_no_rows(spark):
    rows = [(i, f"the cat {i} sat on the mat {i % 7} times") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = bytebpe.decode(bytebpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in got) == rows
    assert bytebpe.document_codes(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_that_are_not_tokens(spark):
    ids = [np.array([0, 60000, 50255], "<u4").tobytes(), None, b""]
    rows = spark.createDataFrame(list(enumerate(ids)), "at long, ids binary").withColumn("DECODED", F.lit("goes"))
    table = {v: k for k, v in bytebpe.ranks(PATH).items()}
    assert [r.decoded and bytes(r.decoded) for r in bytebpe.decode(rows, PATH).orderBy("at").collect()] == [table[0] + table[50255], None, b""]


def test_splitting_follows_the_library():
    split = bytebpe.splitter(public_tokenizers.PATTERN)
    single = {bytes([i]): i for i in range(256)}
    rng = random.Random(1)
    odd = [chr(c) for c in split.stand_in]
    for _ in range(300):
        text = "".join(rng.choice([*" \n'sta1é٣-", rng.choice(odd)]) for _ in range(30))
        # a tokenizer that knows no merges but the whole pieces gives back the pieces
        pieces = list(split.words(text))
        vocabulary = dict(single)
        for p in pieces:
            vocabulary.setdefault(p.encode(), len(vocabulary))
        library = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        assert "".join(pieces) == text and library.encode_ordinary(text) == [vocabulary[p.encode()] for p in pieces]


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = [[[math.floor(256 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in rows]
    books = [[points[e][p] for e in range(min(entries, len(rows)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for x in points:
            for p in range(parts):
                groups[p, nearest(x[p], p)].append(x[p])
        for (p, e), some in groups.items():
            books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    codes = [[nearest(x[p], p) for p in range(parts)] for x in points]
    errors = [sum(far(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(points, codes)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), error, r[2]) for r, code, error in zip(rows, codes, errors)], digest


@pytest.mark.parametrize("spread", [0.02, 0.3, 30.0])
def test_vector_codes(spark, spread, monkeypatch):
    monkeypatch.setattr(covertree, "TREE_ROWS", 150)
    monkeypatch.setattr(common, "FREQUENT", 2)  # some labels are joined by broadcast, some by shuffle
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1, (9, 32))
    vectors = [[float(np.float32(x)) for x in centers[i % 9] + rng.normal(0, spread, 32)] for i in range(400)]
    vectors[20:60] = [vectors[20]] * 40
    rows = [(None if i == 390 else i - i % 50 // 49, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0] * 31 + [float("inf")], None)]
    odd = [(1004, [0.5] * 31, 1), (1005, [], 1), (1006, [1e30] * 32, 2)]
    table = spark.createDataFrame(rows + bad + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = covertree.vector_codes(clash(table), entries=20).collect()
    expected, digest = brute_codes(rows, 16, 20, 2)
    sums = defaultdict(int)
    for _, _, error, label in expected:
        sums[label] += error
    want = [(str(v), c, e, sums[label], digest) for v, c, e, label in expected] + [(str(v), None, None, sums.get(label), digest) for v, _, label in odd]
    assert sorted(map(str, want)) == sorted(str((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got)
    few = covertree.vector_codes(table.where("vec_id in (3, 4, 5)")).collect()
    assert {r.error for r in few} == {0} and covertree.vector_codes(table.limit(0)).count() == 0


def test_trees_cover_and_subtrees_are_assigned_whole():
    rng = np.random.default_rng(8)
    points = np.floor(rng.normal(0, 1, (7, 1, 4)) * 1000 + rng.normal(0, 4, (700, 7, 1, 4))).reshape(-1, 1, 4).astype(np.int64)
    trees = covertree.Trees.unpacked(covertree.grow(points).packed(), 1)
    order = trees.order[0]
    for n in range(len(trees.low)):
        own = points[order[trees.low[n] : trees.high[n]], 0]
        far = np.sqrt(((own - own[0]) ** 2).sum(1))
        assert far.max() <= trees.radius[n] + 1e-9
        children = range(trees.child[n], trees.last[n])
        if len(children):
            assert [trees.low[c] for c in children] + [trees.high[n]] == [trees.low[n], *(trees.high[c] for c in children)]
            scale = 2 ** (math.ceil(math.log2(trees.radius[n])) - 1)
            heads = points[order[[trees.low[c] for c in children]], 0].astype(float)
            gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2))[np.triu_indices(len(heads), 1)]
            assert (gaps > scale).all() and all(trees.radius[c] <= scale for c in children)
    low, high, _, (places, _) = covertree.assign(trees, 0, points[:7, 0])
    assert (high - low).sum() + len(places) == len(points) and len(places) < 0.2 * len(points)


def brute_proofs(rows, fanout=16):
    digest = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def leaf(r, low=False):
        return digest(*(field(v) for v in (r[0], r[3], r[2], r[4], lower(r[1]) if low else r[1])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def climb(levels, at, node, beside):
        for level in levels[:-1]:
            first = at - at % fanout
            left, right = level[first:at], level[at + 1 : first + fanout]
            beside += left + right
            node, at = digest(*left, node, *right), at // fanout
        return node

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for j, r in enumerate(groups[s]):
            beside = []
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            found = climb(top, i, climb(trees[s], j, leaf(r, changed), beside), beside)
            out.append((r[0], trees[s][0][j], trees[s][-1][0], top[-1][0], digest(*beside), found, found == top[-1][0]))
    return out


def test_merkle(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "", "Text", "plain", "ÀÉ Z\n", "a" * 5000]), rng.choice([None, "en"]), rng.choice([None, "", "ß", "a", "hot", "hot", "hot"]), rng.choice([None, i])) for i in range(900)]
    rows += [(900 + i, "One", None, f"source {i:03d}", 3) for i in range(300)]
    rows += [rows[4], rows[4], (5, "other", None, rows[5][3], None), (None, "Null KEY", "en", "hot", 8)]
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(5))
    got = merkle.verified_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_proofs(rows)))
    assert merkle.verified_documents(docs.limit(0)).count() == 0
    lone = merkle.verified_documents(docs.where("doc_id = 905")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("fanout, stride", [(2, 1), (2, 3), (3, 2)])
def test_deep_trees_have_the_same_paths_at_any_stride(spark, fanout, stride):
    leaves = [("a" if i < 150 else f"g{i % 5}", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(180)]
    made = merkle.manifest(spark.createDataFrame(leaves, "group string, k long, digest string"), fanout, stride)
    root = made.root.first().root
    proofs = made.proofs().withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(proofs) == 180 and all(r.root == r.again == root for r in proofs)
    assert len(made.groups.levels) == math.ceil(math.ceil(math.log(150, fanout)) / stride)
    assert {len(r.path) for r in proofs if r.group == "a"} == {math.ceil(math.log(150, fanout)) + math.ceil(math.log(6, fanout))}


def test_pieces_that_no_text_holds_never_match(spark):
    """Control, unknown and byte pieces spelled out in a text are ordinary characters: held against a plain search over the other pieces."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    silent = tokencount.silent_pieces(path)
    assert {"<unk>", "<s>", "</s>", "<0x41>"} <= silent and len(silent) == 259
    score = {p: s for p, s in tokencount.vocabulary(path) if p not in silent}
    least = min(score.values()) - tokencount.UNKNOWN_PENALTY

    def plain(text):
        marked = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)]
        for end in range(1, len(marked) + 1):
            options = [(best[a][0] + score[marked[a:end]], best[a][1] + 1) for a in range(max(0, end - 20), end) if marked[a:end] in score]
            if marked[end - 1] not in score:
                options.append((best[end - 1][0] + least, best[end - 1][1] + len(marked[end - 1].encode())))
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][1]

    texts = ["a<s>b", "x<0x41>y", "x<unk>y", "</s>", "a<q>b", "<0x0A><0xFF>", "plain words 日"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n_tokens for r in tokencount.token_counts(rows, path).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} and got[0] >= 4 and got[1] >= 6
