import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableferry.llm import langid, lm_score, packing, quality, tokens

SF1 = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    documents = spark.read.parquet(f"{SF1}/documents.parquet")
    found = langid.identify(spark, documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.99 and 0 <= right[1] <= right[2] <= 1


def test_languages_of_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "de la que el"), (5, "the and of " * 30_000), (5, "the and")]
    blank = langid.identify(spark, docs(rows)).collect()
    assert len(blank) == 6 and {r["lang_pred"] for r in blank} == {"und"} and {r["score"] for r in blank} == {0.0}
    known = docs([(i, t) for i, t in enumerate(["the and of", "der die und", "le la les"] * 40)]).withColumn(
        "lang", F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("doc_id") % 3 + 1).cast("int"))
    )
    found = langid.identify(spark, known.unionByName(docs(rows))).collect()
    by_id = {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] is not None and r["doc_id"] > 5}
    assert all(lang == ("en", "de", "fr")[i % 3] for i, lang in by_id.items())
    assert langid.identify(spark, docs([])).count() == 0


def test_quality_held_out(spark):
    documents, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(spark, documents, labels)
    assert scored.count() == documents.count()
    found = scored.join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in found]) >= 0.95
    kept = quality.keep_good(spark, documents, labels)
    assert kept.columns == documents.columns
    clean = labels.filter("quality = 1").join(documents, "doc_id", "left_semi").count()
    assert kept.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() >= 0.99 * clean


def test_quality_by_wording_alone(spark, docs):
    """Texts of one layout: five-letter words in sentences of eight; only which words are used tells the labels apart."""
    draw = np.random.default_rng(3)
    pool = np.array(["".join(w) for w in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (900, 5))])
    texts = []
    for i in range(500):
        own = pool[300:600] if i % 2 else pool[600:]
        words = np.where(draw.random(80) < 0.4, draw.choice(own, 80), draw.choice(pool[:300], 80))
        texts.append(" ".join(" ".join(words[k : k + 8]).capitalize() + "." for k in range(0, 80, 8)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id bigint, quality int, toxic int")
    assert len({tuple(np.flatnonzero(quality.shape_counts(t, 64))) for t in texts}) == 1
    found = quality.classify(spark, docs(list(enumerate(texts))), labels).filter("held_out").collect()
    assert len(found) > 60 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in found]) >= 0.95


def test_axes_are_singular_vectors():
    draw = np.random.default_rng(5)
    rows = [(np.sort(draw.choice(400, 30, replace=False)), draw.random(30).astype(np.float32) * (1 + i % 3)) for i in range(90)]
    dense = np.zeros((90, quality.DIMS), np.float32)
    for line, (bins, weights) in zip(dense, rows):
        line[bins] = weights
    axes = quality.main_axes(rows)
    assert np.allclose(axes.T @ axes, np.eye(quality.RANK), atol=1e-3)
    exact = np.linalg.svd(dense, full_matrices=False)[1]
    assert np.linalg.norm(dense @ axes) >= 0.99 * np.linalg.norm(exact[: quality.RANK])


def test_quality_of_odd_rows(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (3, "y")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in quality.classify(spark, rows, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.classify(spark, rows, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert quality.classify(spark, docs([]), labels).count() == 0


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sré1.,<|>漢😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    assert tokens.encode(text, tokens.default_ranks()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_the_added_token_is_one_id():
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "x\n\n<|endoftext|><|endoftext|>  y", "<|endoftext|"]
    for text in texts:
        assert tokens.encode(text, tokens.default_ranks()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert tokens.encode(texts[0], tokens.default_ranks()).tolist() == [64, 50256, 65]


def unpacked(rows):
    """The ids of each document, and the sequences' lengths, from the pieces; every piece is where it should be."""
    sequences, texts = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        have = texts.setdefault(r["doc_id"], [])
        assert len(have) == r["start"] and r["length"] == len(r["ids"]) // 4
        have.extend(np.frombuffer(r["ids"], "<u4").tolist())
    for r in rows:
        assert r["doc_tokens"] == len(texts[r["doc_id"]])
    return texts, sequences


@pytest.mark.parametrize("window, shard", [(1024, 1 << 20), (64, 500)])
def test_packing_is_a_round_trip(spark, sample, window, shard):
    texts, sequences = unpacked(packing.pack(spark, sample, window=window, shard_tokens=shard).collect())
    for doc_id, text in sample.select("doc_id", "text").collect():
        assert texts.pop(doc_id) == TOKENIZER.encode(text, add_special_tokens=False).ids + [0]
    assert not texts
    short = [n for n in sequences.values() if n < window]
    assert max(sequences.values()) <= window and len(short) <= sample.rdd.getNumPartitions()


def test_packing_of_odd_rows(spark, docs):
    rows = packing.pack(spark, docs([(1, None), (2, ""), (3, "word " * 50_000), (4, "a")])).collect()
    texts, _ = unpacked(rows)
    assert texts[1] == [0] and texts[2] == [0] and len(texts[3]) > 50_000 and texts[4][-1] == 0
    twice = packing.pack(spark, docs([(7, "a b"), (7, "a b"), (None, "c")])).collect()
    assert sorted(r["length"] for r in twice) == [2, 3, 3] and packing.pack(spark, docs([])).count() == 0


def test_neighbours_are_all_of_bm25():
    """Every unused part that shares a term with the seed, ranked by a plain BM25 over all terms of the seed."""
    draw = np.random.default_rng(11)
    parts = [draw.zipf(1.3, int(draw.integers(1, 200))).clip(max=400).astype(np.uint16) for _ in range(300)]
    parts += [parts[4], parts[4]]
    seen = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=packing.IDS)
    corpus = packing.Corpus(np.log(1 + (len(parts) - seen + 0.5) / (seen + 0.5)), float(np.mean([len(p) for p in parts])))
    shard = packing.Shard(parts, corpus)
    shard.left[[4, 7, 8]] = 0
    for seed in (4, 7):
        scores = {}
        for place, part in enumerate(parts):
            norm = packing.K1 * (1 - packing.B + packing.B * len(part) / corpus.mean_length)
            times = {t: int((part == t).sum()) for t in set(parts[seed].tolist())}
            score = sum(corpus.idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in times.items() if n)
            if score and place not in (4, 7, 8):
                scores[place] = score
        ranking = np.concatenate(list(shard.neighbours(seed))).tolist()
        assert sorted(ranking) == sorted(scores) and len(ranking) > packing.NEIGHBOURS
        falling = [scores[p] for p in ranking]
        assert all(a >= b - 1e-9 for a, b in zip(falling, falling[1:]))
        assert ranking.index(300) < ranking.index(301)


def test_packing_puts_like_texts_together(spark, docs):
    kinds = ["red apple pear fruit juice " * 4, "motor wheel engine brake gear " * 4]
    rows = packing.pack(spark, docs([(i, f"{kinds[i % 2]} n{i}") for i in range(40)]).coalesce(1), window=128).collect()
    mixed = {}
    for r in rows:
        mixed.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert sum(len(k) == 1 for k in mixed.values()) >= 0.7 * len(mixed)


def test_lm_scores_against_the_formula(spark, docs):
    rows = [(0, "a b a b"), (1, "a b c"), (2, "d e f"), (3, None), (None, "a b")]
    good = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id bigint")
    got = {r["doc_id"]: r for r in lm_score.scores(spark, docs(rows), good).collect()}
    ids = {i: [lm_score.START, *TOKENIZER.encode(t or "", add_special_tokens=False).ids] for i, t in rows}

    def loss(own, all_docs):
        single, first, pair, seen = {}, {}, {}, set()
        for i in all_docs:
            seen |= set(ids[i][1:])
        for i in own:
            for a, b in zip(ids[i], ids[i][1:]):
                single[b] = single.get(b, 0) + 1
                first[a] = first.get(a, 0) + 1
                pair[a, b] = pair.get((a, b), 0) + 1
        total = sum(single.values()) + lm_score.ADDED * len(seen)

        def of(doc):
            out = []
            for a, b in zip(ids[doc], ids[doc][1:]):
                share = (single.get(b, 0) + lm_score.ADDED) / total
                out.append(-np.log((pair.get((a, b), 0) + lm_score.MIX * share) / (first.get(a, 0) + lm_score.MIX)))
            return float(np.mean(out)) if out else 0.0

        return of

    near, far = loss([0, 1], ids), loss(list(ids), ids)
    for i in ids:
        assert got[i]["score"] == pytest.approx(near(i) - far(i)) and got[i]["n_tokens"] == len(ids[i]) - 1
    assert got[2]["score"] > 0 > got[0]["score"]
    assert {r["score"] for r in lm_score.scores(spark, docs(rows), good.limit(0)).collect()} == {0.0}
    assert lm_score.scores(spark, docs([]), good).count() == 0


def test_lm_counts_every_pair_by_itself(spark, docs):
    """In a table of fixed size many of these pairs would share a place."""
    rng = np.random.default_rng(5)
    words = sorted(w[1:] for w in TOKENIZER.get_vocab() if w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha())
    rows = [(i, " ".join(rng.choice(words, 2500))) for i in range(120)]
    good = spark.createDataFrame([(i,) for i in range(0, 120, 3)], "doc_id bigint")
    got = {r["doc_id"]: r for r in lm_score.scores(spark, docs(rows).repartition(3), good, chunk_tokens=50_000).collect()}
    ids = [np.array([lm_score.START, *TOKENIZER.encode(t, add_special_tokens=False).ids]) for _, t in rows]
    codes = [x[:-1] << 16 | x[1:] for x in ids]
    assert len(np.unique(np.concatenate(codes))) > 200_000
    vocabulary = len(np.unique(np.concatenate([x[1:] for x in ids])))
    for kind, own in (("target_loss", codes[::3]), ("background_loss", codes)):
        own = np.concatenate(own)
        single, first = np.bincount(own & 65535, minlength=1 << 16), np.bincount(own >> 16, minlength=1 << 16)
        pairs, times = np.unique(own, return_counts=True)
        for i, c in enumerate(codes):
            at = np.minimum(np.searchsorted(pairs, c), len(pairs) - 1)
            n = np.where(pairs[at] == c, times[at], 0)
            share = (single[c & 65535] + lm_score.ADDED) / (single.sum() + lm_score.ADDED * vocabulary)
            want = -np.log((n + lm_score.MIX * share) / (first[c >> 16] + lm_score.MIX)).mean()
            assert got[i][kind] == pytest.approx(want, abs=1e-9)
