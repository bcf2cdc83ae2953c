"""The byte-to-text machine against a plain decoder of whole texts."""

import hashlib

from tokenizers import Tokenizer

from sparkboard.llm import bpe
from sparkboard.llm.queries import op1_bpe, tokenizer_file
from sparkboard.llm.shared import shipped


def plain(text, reference, tokenizer):
    raw = b""
    for token in reference.encode(text or "", add_special_tokens=False).tokens:
        if token in tokenizer.special:
            raw += token.encode() + b" "
        else:
            sign, ends = token.removesuffix(tokenizer.end), token.endswith(tokenizer.end)
            raw += bytes(tokenizer.sign_bytes[c] for c in sign) + b" " * ends
    return hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()


def test_readable_digests_equal_a_plain_decoder(spark, sf001):
    shipped(spark)
    reference, tokenizer = Tokenizer.from_file(tokenizer_file()), bpe.load(tokenizer_file())
    reference.no_truncation()
    reference.no_padding()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "żółć ☃ 𝄞 <|endoftext|> x"), (-4, "é" * 3000), (-4, "é" * 3000)], "doc_id long, text string")
    want = sorted((r["doc_id"], plain(r["text"], reference, tokenizer)) for r in docs.unionByName(odd).collect())
    found = bpe.encoded_digests(docs.unionByName(odd), tokenizer_file(), readable=True)
    assert sorted((r["id"], r["readable_sha256"]) for r in found.collect()) == want
    assert op1_bpe(spark, sf001).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "readable_sha256"]
    assert bpe.encoded_digests(odd.limit(0), tokenizer_file(), readable=True).count() == 0
