import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import components, jaccard, licenses, neighbours, pieces, quality, rans
from tickloom.llm import words as wordcodes
from tickloom.llm.fingerprints import edited_fingerprints
from tickloom.llm.language import DIM, fit_languages, identify_languages, letter_vector, text_vectors
from tickloom.llm.mixing import mix_sources
from tickloom.llm.queries import vocabulary
from tickloom.llm.shared import Memo, flagged, run_folder
from tickloom.llm.substrings import dedup_substrings
from tickloom.llm.token_files import UnitEncoder, new_path, read_tokens, write_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)] + ["É", "ß", "日本", "Licence"]
    rows = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 5, 30, 80]))]
        if rows and k % 3 == 0:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            if w and k % 2:
                w[rng.randrange(len(w))] = "CHANGED"
        rows.append((k * 3, " ".join(w) + "\n" * (k % 2), "xy"[k % 2], [None, "a", "b", "c"][k % 4], None, "clash"))
    return [*rows, (500, None, None, "a", None, None), (501, "", "x", None, 0, None), (502, " \t", "x", "b", 0, None), (503, "long " * 5000, "x", "b", 0, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def words(x):
    return [w.decode() for w in (x or "").encode().split()]


def roots(ids, links):
    up = {i: i for i in ids}

    def f(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(f(a), f(b))] = min(f(a), f(b))
    return {i: f(i) for i in ids}


@pytest.mark.parametrize("merged, probes", [(4096, 8), (0, 0), (4096, 0), (0, 10**9), (10**9, 10**9)])
def test_search_of_a_block(monkeypatch, merged, probes):
    monkeypatch.setattr(jaccard, "MERGED", merged)
    monkeypatch.setattr(jaccard, "PROBES", probes)
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(1, 30)):
            x = base[rng.integers(0, 4)]
            sets.append(np.unique(np.r_[x[rng.random(len(x)) < 0.93], rng.integers(0, 400, rng.integers(0, 4)), x[:1]]).astype(np.uint64))
        near = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(inter := np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - len(inter))]
        found = jaccard.cluster_links(sets, 75)
        assert {tuple(sorted(x)) for x in found} <= set(near) and roots(range(len(sets)), found) == roots(range(len(sets)), near)


@pytest.mark.parametrize("long, block, cluster", [(48, 512, 32_768), (2, 2, 32_768), (2, 2, 2)])
def test_jaccard(docs, monkeypatch, long, block, cluster):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CLUSTER", cluster)
    sets = {}
    for i, x, *_ in corpus():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert links and {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_beyond_what_is_broadcast(spark, docs, monkeypatch):
    """Of a large table only the texts asked for are joined, and tables that nothing reads again are deleted."""
    key = lambda *names: [F.col(c) for c in names]
    table = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("_id"), F.col("id").cast("string").alias("_text"), F.xxhash64("id").alias("_tag"))
    wanted = table.where("_id % 100 = 7 OR _id IS NULL").select("_id", "_tag", F.lit(1).alias("cls"))
    near = flagged(table, key("_id", "_tag"), wanted, key("_id", "_tag"), "near").where("near")
    assert near.count() < 201 + 20_000 // 50 and near.join(wanted, "_tag").count() == 201
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    found = jaccard._texts_of(wanted, table)
    assert found.count() == 201 and "_maybe" in found._jdf.queryExecution().toString()
    folder = run_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = {tuple(r) for r in jaccard.jaccard_components(docs).collect()}
    new = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert "clustered" in new and not new & {"lists", "posted"}
    monkeypatch.undo()
    assert got == {tuple(r) for r in jaccard.jaccard_components(docs).collect()}


def test_substrings(docs):
    owner, got = {}, {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs).collect()}
    texts = {i: words(x) for i, x, *_ in corpus()}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 12):
            owner.setdefault(tuple(texts[i][k : k + 13]), i)
    for i, w in texts.items():
        gone = {j for k in range(len(w) - 12) if owner[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        assert got[i] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(x[1] for x in got.values())


def test_words_are_compared_byte_for_byte(spark):
    a = "0"
    while len(a) < 4096:  # polynomial hashes modulo 2^64 are equal for this word and its complement
        a += a.translate(str.maketrans("01", "10"))
    b = a.translate(str.maketrans("01", "10"))
    same = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same}  {a}\tx"), (2**63 - 1, f"{same} {b} y"), (None, f"{same} {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(df).collect()}
    assert got == {1: (13, 0), 2: (13, 0), 3: (14, 13), 2**63 - 1: (14, 13), None: (13, 13)}
    df = spark.createDataFrame([(1, f"p q r s {a}"), (2, f"p q r s {b}"), (3, f"p q r s {b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 2}


def test_codes_of_words_and_runs():
    rng = random.Random(9)
    for n in (1, 2, 5, 8, 13):
        w = [rng.choice(["a", "bb", "日本", "c"]) for _ in range(300)]
        buf = "".join(x + rng.choice([" ", "\n", " \t "]) for x in w).encode()
        starts, ends, codes = wordcodes.word_codes(buf)
        assert [buf[s:e].decode() for s, e in zip(starts, ends, strict=True)] == w
        runs = wordcodes.run_codes(codes, n)
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        assert len(runs) == len(grams) and len(set(runs.tolist())) == len(set(grams)) == len(set(zip(runs.tolist(), grams, strict=True)))
    assert len(wordcodes.word_codes(b"")[2]) == len(wordcodes.word_codes(b" \n")[2]) == len(wordcodes.run_codes(np.zeros(3, np.int64), 4)) == 0


def test_fingerprints(docs):
    def canonical(x):
        nfkc = lambda y: unicodedata.normalize("NFKC", y)
        return re.sub(r"\s+", " ", nfkc(nfkc(x).casefold())).strip(" ")

    rows, got, seen = sorted((i, x or "") for i, x, *_ in corpus()), {r.doc_id: r for r in edited_fingerprints(docs).collect()}, {}
    for k, (i, x) in enumerate(rows):
        y, m = rows[(k + 1) % len(rows)][1], len(x) // 4
        e, r = x[: len(x) - m] + y[:m], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(x) == canonical(e)), float(canonical(x) == canonical(y)))
        assert seen.setdefault(canonical(x), r.fingerprint) == r.fingerprint and seen.setdefault(canonical(e), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(seen.values())) == len(seen)


def test_mixing(docs):
    got = mix_sources(docs).collect()
    text = {i: (x, s) for i, x, _, s, *_ in corpus()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(words(text[r.doc_id][0])) and 0 <= r.taken <= 2 * r.size
        s = text[r.doc_id][1]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert all(taken[s] == round(target[s]) <= 2 * size[s] for s in size) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(got) == sorted(mix_sources(docs.repartition(7)).collect())


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else 7, " ".join(["w"] * (k % 9)) + f" t{k // 3}", "s", str(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = sorted((r.doc_id is None, r.tag, r.taken) for r in mix_sources(df).collect())
    assert got == sorted((r.doc_id is None, r.tag, r.taken) for r in mix_sources(df.repartition(5)).collect())
    assert sum(t for *_, t in got) == int(1.5 * sum(k % 9 + 1 for k in range(3000)) + 0.5)


def test_units_of_text_give_the_ids_of_the_library():
    path = vocabulary("byte_bpe_50k.json")
    encoder, rng = UnitEncoder(path), random.Random(7)
    texts = ["a\n\n\nb\tc\td", "col1\tcol2 ", "a b\tc", "a\t b", "a \tb", "\ta b", "a b\t", "a\tb\n\nc", "a  b\u3000c", "a\r\nb\n\nc", "a\u00a0b  c", "\n", " ", "a\n", "\na", "a \nb", "a\n b", "a\x1cb  c", "a b\nc"]
    texts += ["".join(rng.choice(["a", "b's", "1", "é", "<|endoftext|>", *" \n \n\t\r\x0b\x1c\x85\u00a0\u2028\u3000\u200b"]) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["Größe,", "x.", "naïve!!", "don't.", "3,", "½.", "…", "«oui».", "日本.", "a\u0378.", ".,", "'s,", "<|endoftext|>."]) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    texts += [None, ""]
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def check(order, end=None):
        ids, n = encoder.encode(pa.array([texts[k] for k in order]), end)
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in got] == [[*want[k], *([] if end is None else [end])] for k in order]

    check(range(len(texts)))
    check(rng.sample(range(len(texts)), len(texts)), 0)  # again, from what is remembered, in another order
    for k in (0, 1, len(texts) - 1):
        check([k], 0)
    assert not any(c.isspace() for unit in encoder.known.young for c in unit[1:])
    encoder.known = Memo(100)  # what is forgotten and found again changes nothing
    for k in range(0, len(texts), 700):
        check(range(k, min(k + 900, len(texts))), 0)
    assert len(encoder.known.young) < 50
    assert len(encoder.encode(pa.array([], pa.string()))[1]) == 0


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path, t = vocabulary("byte_bpe_50k.json"), new_path(spark)
    write_tokens(docs, path, t)
    lib, start, got = Tokenizer.from_file(path), 0, {r.doc_id: r for r in read_tokens(spark, t).collect()}
    for i, x, *_ in sorted(corpus(), key=lambda r: r[0]):
        ids = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("n", [1, 7, 2049, 600_000])
def test_rans_blocks(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint16)
    table = rans.Table.of(np.bincount(ids))
    block = rans.encode(ids, table.encoder())
    assert (rans.decode(block, table.decoder()) == ids).all()
    if n > rans.CHECKPOINT:
        assert (rans.decode(block, table.decoder(), 1) == ids[rans.CHECKPOINT :]).all()
    with pytest.raises(ValueError):
        rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table.decoder())


def test_pieces(docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    texts = [x for _, x, *_ in corpus()] + ["a  b\nc ﬁ é  ", " lead", "\n\n日本語 <s> </s>", "aaaa  aaaaaaaa", "\t\ttab"]
    for x, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(x or "") and model.decode(ids) == (x or "")
    model.known = Memo(40)
    for k in range(0, len(texts), 30):
        assert [x.tolist() for x in model.encode(texts[k : k + 40])] == [lib.encode(x or "") for x in texts[k : k + 40]]
    assert all(r.round_trip for r in pieces.encode_pieces(docs, path).collect())


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    rows = [base[k % 60] + rng.normal(size=64) * (0.0 if k % 3 else 0.25) for k in range(300)]
    data = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(rows)] + [(300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, [None] * 64), (304, [])]
    got = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in data[:300]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[k].n_links for k in range(300))
    assert 0.9 * close.sum() <= found <= close.sum() and all(got[k].n_links <= close[k].sum() for k in range(300))
    want = roots(range(300), [(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True)])
    assert all(want[got[k].component_id] == want[k] and got[k].kept == (got[k].component_id == k) for k in range(300))
    assert sum(got[k].component_id == want[k] for k in range(300)) >= 0.9 * 300
    assert [neighbours.shape_for(n) for n in (0, 10**8, 10**9, 10**10)] == [(6, 3), (6, 3), (11, 4), (18, 5)]
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    other = rng.normal(size=unit.shape)
    other -= (other * unit).sum(1, keepdims=True) * unit
    other = 0.9 * unit + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)  # pairs at cosine 0.9, the hardest ones
    for tables, hashes in ((6, 3), (11, 4), (18, 5)):
        a, b = (neighbours.bucket_names(v, tables, hashes) for v in (unit, other))
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.9
    more = [(7, [1.0, 0.0], "clash"), (7, [1.0, 0.0], "clash"), (None, [2.0, 0.0], None), (9, [1.0, 0.1], ""), (None, None, ""), (3, [1.0, 0.0, 0.0], "")]
    out = neighbours.near_vectors(spark.createDataFrame(more, "vec_id long, embedding array<double>, n_links string")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == Counter({(7, 3, 7): 2, (None, 3, 7): 1, (9, 3, 7): 1, (None, 0, None): 1, (3, 0, 3): 1})
    assert all(got[k].n_links == 0 and got[k].kept for k in range(300, 305))


def test_licenses_of_any_length_and_part(spark):
    rng = random.Random(4)
    long, middle = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("n", 200), ("m", 50)))
    own = [("long", long), ("middle", middle), *licenses.TEMPLATES]
    fill = lambda n: " ".join(rng.choice("pqrs") for _ in range(n))
    parts = [(label, text) for label, text in own for _ in range(5)]
    rows = [(k, f"{fill(rng.randrange(400))} {text} {fill(rng.randrange(400))}") for k, (_, text) in enumerate(parts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=own, phrases={}).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == 1.0 for k, (label, _) in enumerate(parts))
    assert all(len(licenses.words_of(t)) <= licenses.STRIDE + 1 for _, t in licenses.TEMPLATES)
    # sentences that only one license has; those of others do not answer to them
    only = {"bsd": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "mit": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software"}
    df = spark.createDataFrame(list(enumerate(only.values())), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == list(only)


def test_licenses(docs, spark):
    index = licenses.TemplateIndex(licenses.TEMPLATES, {b"the": 9, b"license": 5}, 0.85)
    rng = random.Random(1)
    pool = licenses.words_of(" ".join(t for _, t in licenses.TEMPLATES)) + [b"other"] * 20
    tried = 0
    for _ in range(40):
        w = [rng.choice(pool) for _ in range(100)] + licenses.words_of(rng.choice(licenses.TEMPLATES)[1])
        want = set()
        for s in range(0, len(w), licenses.STRIDE):
            block = set(w[s : s + licenses.BLOCK])
            for label, t in licenses.TEMPLATES:
                t = set(licenses.words_of(t))
                if len(block & t) >= 0.85 * len(t) - 1e-9:
                    want.add((s, label, len(block & t) / len(t)))
        assert set(index.find(w)) == want
        stop = [index.filtered(sorted({index.rank[x] for x in w[s : s + 64] if x in index.rank}), licenses.STRIDE) for s in range(0, len(w), 32)]
        tried += sum(map(len, stop))
    assert 0 < tried < 40 * 4 * len(licenses.TEMPLATES)  # not all are counted
    ten = licenses.TemplateIndex([("x", "a b c d e f g h i j")], {}, 0.8)  # one of the first three words must be met, with eight left
    assert [bool(ten.filtered(sorted(ten.rank[w.encode()] for w in words), licenses.STRIDE)) for words in ("abcdefgh", "cdefghij", "bdefghij", "adefghi", "defghij")] == [True, True, True, False, False]
    rows = [(k, " ".join(rng.choice(["mit", "MIT", "license", "apache", "General", "public", "x", "-", "licence,", "é"]) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(None, "mit license"), (None, "mit license"), (900, "mit license " * 20_000), (901, "")]
    got = licenses.scan_licenses(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, labels string, score int")).collect()
    assert len(got) == len(rows)
    seen = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    want = Counter()
    for k, text in rows:
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[k, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert seen == want
    df = spark.createDataFrame([(1, "x MIT\nLicense, general public-license mit license"), (2, None)], "doc_id long, text string")
    a, b = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (8, 3, 1, 6, "gpl,mit") and (b.n_words, b.n_base, b.first_word, b.labels, b.score) == (0, 0, None, "", 0.0)


def test_models(spark, docs):
    d = "/root/testdata/sf0.01"
    real, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(real.select("doc_id", "text"), quality.fit_quality(real, labels)).withColumn("h", quality.held_out("doc_id", 5, 0)).join(labels, "doc_id").where("h").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in out) >= 0.95 * len(out)
    out = identify_languages(real.select("doc_id", "text", "lang"), fit_languages(real)).withColumn("h", quality.held_out("doc_id", 4, 2)).where("h").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert {r.lang_pred for r in identify_languages(docs.where("doc_id IN (500, 501, 502)").select("doc_id", "text"), fit_languages(real)).collect()} == {"und"}


def test_additive_scores_by_row(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        z = model.base
        for f, edges in enumerate(model.edges):
            z += model.tables[f][sum(row[f] >= e for e in edges)]
        for (a, b), table in model.pairs.items():
            z += table[sum(row[a] >= e for e in model.grid[a]), sum(row[b] >= e for e in model.grid[b])]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9 and model.pairs
    rows = [(1, "a b c", 9.0, "x"), (1, "a b c", 9.0, "x"), (None, None, None, None), (2, "word " * 200_000, 1.0, None), (3, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, quality string")
    model = quality.AdditiveModel(np.array([quality.features(t) for t in ("a b", "a b", "!!! ###", "") for _ in range(20)]), np.repeat([1.0, 1.0, 0.0, 0.0], 20))
    got = quality.score_quality(docs, model).collect()
    want = {t: float(model.score(np.array([quality.features(t)]))[0]) for _, t, *_ in rows}
    assert len(got) == 5 and all(r.score == pytest.approx(want[r.text]) and 0 <= r.score <= 1 for r in got)


def test_bundles_by_letter(spark):
    def brute(text):
        letters = re.findall(r"[^\W\d_]+", text.lower())
        codes = [0, *(c for w in letters for c in [*map(ord, w), 0])]
        if not letters or not text[-1:].isalpha():
            codes = codes if letters else []
        else:
            codes = codes[:-1]
        out = np.zeros(DIM)
        for k in range(len(codes) - 2):
            a, b, c = (letter_vector(x) for x in codes[k : k + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
        return out / max(np.linalg.norm(out), 1e-9)

    texts = ["one two", "Ein Öl, und 3 mehr!", "日本語のテキスト", "a", "", None, "12 3", "x y z. ", "mixed ÄÖ words " * 40]
    got = text_vectors(texts)
    for t, v in zip(texts, got, strict=True):
        assert np.allclose(v, brute(t or ""), atol=1e-4), t
    assert np.allclose(text_vectors(["ab cd " * 100_000])[0], text_vectors(["ab cd " * 50])[0], atol=1e-2)
    docs = spark.createDataFrame([(1, "aaa bbb", "x", 1), (2, "ccc ddd", "y", 1), (3, "ccc aaa", None, 2), (None, "aaa", "x", 3), (1, "aaa bbb", "x", 1), (4, None, "y", 0)], "doc_id long, text string, lang string, score int")
    out = identify_languages(docs, fit_languages(docs)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and [r.lang_pred for r in out if r.text is None] == ["und"]
    assert {r.lang_pred for r in out if r.text == "aaa bbb"} == {"x"}
    same = {"b": np.ones(DIM, np.float32), "a": np.ones(DIM, np.float32)}
    assert {r.lang_pred for r in identify_languages(docs.where("text IS NOT NULL"), same).collect()} == {"a"}  # a tie goes to the first


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = new_path(spark)
    write_tokens(none, vocabulary("byte_bpe_50k.json"), path)
    model = quality.fit_quality(none, spark.createDataFrame([], "doc_id long, quality int"))
    for out in (
        jaccard.jaccard_components(none), dedup_substrings(none), edited_fingerprints(none), mix_sources(none), read_tokens(spark, path), licenses.scan_licenses(none),
        quality.score_quality(none, model), identify_languages(none, fit_languages(none)), pieces.encode_pieces(none, vocabulary("piece_bpe_32k.model")),
        neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()) == Counter({(1, 10, 1): 2, (None, 10, 1): 1, (None, 0, None): 1})
    assert sorted((r.doc_id or 9, r.n_removed) for r in dedup_substrings(df).collect()) == [(1, 0), (1, 0), (9, 0), (9, 14)]
    assert edited_fingerprints(df).count() == 4 and sum(r.taken for r in mix_sources(df).collect()) == 63
    assert defaultdict(int, Counter(r.n_pieces > 0 for r in pieces.encode_pieces(df, vocabulary("piece_bpe_32k.model")).collect()))[True] == 3


@pytest.mark.parametrize("bound", [components.CONTRACTED, 3])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, bound):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(20)]
    want = roots({x for e in edges for x in e}, edges)
    monkeypatch.setattr(components, "CONTRACTED", bound)
    frame = spark.createDataFrame([*edges, edges[0], (7, 7), (300, None)], "u long, v long")
    got = components.components(frame.repartition(3)).collect()
    assert Counter((r.node, r.root) for r in got) == Counter((n, r) for n, r in want.items() if n != r)
