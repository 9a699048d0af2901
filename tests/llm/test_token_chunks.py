"""Chunk maps composed in a tree give the library's counts, for any chunk size and script."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tokenizers  # noqa: E402

from palimpsest.llm import token_counts  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(2)
    chinese = "".join(rng.choice("".join(map(chr, range(0x4E00, 0x4E80))) + "，。、 ") for _ in range(1500))
    thai = "".join(map(chr, rng.choices(range(0xE01, 0xE4F), k=900)))
    mixed = "".join(rng.choices(["it's", " don't", "'re", "  ", "\n", "x1", "é", "中文", "...", "'", "<|endoftext|>", " a", "٣"], k=900))
    return [chinese, thai, mixed, "a" * 2000, "'" * 500 + "s" * 500, " " * 700 + "x", "<|endoftext|>" * 90, "<|endoftext|", None, "", "short"]


@pytest.mark.parametrize("chunk,fan", [(7, 2), (64, 3), (1000, 16)])
def test_any_chunk_size(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(token_counts, "FAN", fan)
    tok = tokenizers.Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTES, 512, chunk).collect()}
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts()]
    assert got == {i: (n, n > 512) for i, n in enumerate(want)}


def test_boundaries_in_any_script():
    machine = token_counts.transducer(BYTES)
    head, _, tail = machine.chunk_map("中文，没有空格。".encode())
    assert tail is not None and len(head) < 10
