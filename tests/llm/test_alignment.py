import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tableferry.llm import alignment, queries, tokens

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "Hello, world!  Two  spaces\tand\na line", "Grüße an die schöne Welt", "日本語 text ✓ 🙂🙂", " leading and trailing ", "\n\n x", "a" * 3000,
    "<|endoftext|> <s> </s> <unk> <0x41>", "▁ is a mark", "x ▁y", "ﬁne ½ Å", "á é", "\x00 nul", "", None, "word", "word", " ", "　wide",
    "one  two   three    four", "don't we'll 12345 6.78", "ü x", "x ü x ü", "tab\t tab", "nbsp  nbsp", "word word word", "é " * 500,
]


def bytes_of_a():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    return lambda i: bytes(chars[c] for c in A.id_to_token(i))


def bytes_of_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    of_a, found = bytes_of_a(), []
    for doc_id, text in rows:
        a = A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        left, right = [of_a(i) for i in a], [bytes_of_b(i) for i in b]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            found.append((doc_id, [], [], [], ""))
            continue
        left, right = spans(left), spans(right)
        links, start = [], 0
        for i, (x, y) in zip(a, left):
            for k in range(start, len(b)):
                u, v = right[k]
                if u >= y:
                    break
                if v > x:
                    links.append((i, b[k]))
                else:
                    start = k
        ends = sorted({y for _, y in left} & {y for _, y in right})
        groups, low = [], 0
        for end in ends:
            groups.append(
                ",".join(str(i) for i, (x, y) in zip(a, left) if low <= x < end) + "|" + ",".join(str(i) for i, (x, y) in zip(b, right) if low <= x < end)
            )
            low = end
        found.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(p for f in found for p in set(f[3]))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return sorted(
        (d, len(a), len(b), line.count(";") + 1 if line else 0, len(links), sum(counts[p] == highest[p[0]] for p in links),
         sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if line else "") for d, a, b, links, line in found
    )


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("chunk_pairs", [40, alignment.CHUNK_PAIRS])
def test_odd_texts_against_brute_force(spark, docs, chunk_pairs):
    frame = docs(ODD)
    got = result(alignments := alignment.alignments(spark, frame, chunk_pairs=chunk_pairs))
    assert got == brute(list(enumerate(ODD)))
    assert alignments.columns == COLUMNS


def test_sample_against_brute_force(spark, sample):
    some = sample.limit(25).unionByName(sample.limit(8))
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert result(alignment.alignments(spark, some)) == brute(rows)


def test_query_keeps_every_row(spark):
    path = "/root/testdata/sf0.001"
    assert queries.QUERIES["op12_token_alignment"](spark, path).count() == spark.read.parquet(f"{path}/documents.parquet").count()


def test_no_rows_and_null_ids(spark, docs):
    assert alignment.alignments(spark, docs([])).collect() == []
    got = alignment.alignments(spark, docs([(None, "same text"), (None, None), (3, "same text")])).collect()
    assert sorted((str(r["doc_id"]), r["n_a"] > 0) for r in got) == [("3", True), ("None", False), ("None", True)]


def test_words_are_cut_as_in_the_whole_text():
    paths = tokens.default_ranks(), public_tokenizers.path("piece_bpe_32k.model")
    assert not alignment._crosses(paths[1])
    texts = [t for t in ODD if t]
    assert alignment.align(texts, *paths) == [alignment.align_words([t], *paths)[0] for t in texts]
    for t in texts:
        assert list(tokens.ordinary(t, paths[0])) == A.encode(t, add_special_tokens=False).ids


def test_kept_words_are_bounded(monkeypatch):
    paths = tokens.default_ranks(), public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "KEPT_WORDS", 5)
    for i in range(4):
        alignment.align([f"a{i} b{i} c{i} " + "d" * 100], *paths)
    assert len(alignment._known(*paths)) <= 8 and "d" * 100 not in alignment._known(*paths)
