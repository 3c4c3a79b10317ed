"""Token alignment against an alignment token by token."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quantloom.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
CHARS = {chr(b): b for b in BYTES} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in BYTES)}


def brute(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def bytes_b(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for d, text in docs:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [bytes(CHARS[c] for c in a.id_to_token(k)) for k in ia], [bytes_b(k) for k in ib]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            rows.append((d, [], [], [], []))
            continue
        spans = []
        for t in (ta, tb):
            at, out = 0, []
            for x in t:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, i, j = [], 0, 0
        while i < len(ia) and j < len(ib):
            links.append((ia[i], ib[j]))
            ea, eb = spans[0][i][1], spans[1][j][1]
            i, j = i + (ea <= eb), j + (eb <= ea)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for c in cuts:
            i0, j0 = i, j
            while i < len(ia) and spans[0][i][1] <= c:
                i += 1
            while j < len(ib) and spans[1][j][1] <= c:
                j += 1
            groups.append(",".join(map(str, ia[i0:i])) + "|" + ",".join(map(str, ib[j0:j])))
        counts.update(links)
        rows.append((d, ia, ib, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d, ia, ib, groups, links in rows:
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((d, len(ia), len(ib), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TEXTS = [
    None, "", "a", " ", "  two  blanks ", "Tokenization of unbelievable wording.", "it's <|endoftext|> and </s> or <s> <unk>", "tab\tline\n\nend", "▁ a mark that B reads as a blank", "日本語 テスト", "naïve Straße — “quotes” …",
    "\x00\x01\x1c\x85\xa0　x", "🙂🙃 emoji", "ｆｕｌｌ width", "é combining", "İI ŉ ǅ", "the same", "the same", "<0x41> written out", "1234567890 " * 50, "힣\U0010ffff", "word " * 60_000, "x" * 3000, "\r\n\r\n",
]


@pytest.mark.parametrize("block_links,parts", [(2_000_000, 3), (1, 1)])
def test_equals_token_by_token(spark, block_links, parts):
    docs = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS)] + [(5, "the same")]
    table = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, block long, pairs string, ids string").repartition(parts)
    got = sorted(map(tuple, token_alignment.align(table, A, B, block_links).collect()), key=repr)
    assert got == brute(docs)
    assert sum(r[1] == 0 for r in got) < 8


def test_whole_table(spark, docs):
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, token_alignment.align(docs, A, B, 50_000).collect()), key=repr) == expected
    assert all(r[1] for r in expected)


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(table, A, B).count() == 0


def test_other_id_types(spark):
    table = spark.createDataFrame([("b", "some text"), (None, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_groups > 0) for r in token_alignment.align(table, A, B).collect()) == [("", False), ("b", True)]
