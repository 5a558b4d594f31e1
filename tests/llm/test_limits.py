"""Tokenizers that work otherwise are refused, and texts of long words fill more than one block."""

import public_tokenizers
import pytest

from tidemark.llm import pieces, tokens


def test_other_tokenizers_are_refused(tmp_path):
    tokens.refuse_others(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="not supported"):
        tokens.refuse_others(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    for k, (old, new) in enumerate((('"Lowercase"', '"Strip"'), ('"content": "<|endoftext|>"', '"content": "[END]"'))):
        changed = tmp_path / f"{k}.json"
        changed.write_text(text.replace(old, new, 1) if old in text else text.replace(old.replace(": ", ":"), new.replace(": ", ":"), 1))
        assert changed.read_text() != text
        with pytest.raises(ValueError, match="not supported"):
            tokens.refuse_others(str(changed))


def test_texts_of_long_words_fill_several_blocks(spark, monkeypatch):
    import sentencepiece

    path, blocks = public_tokenizers.path("piece_bpe_32k.model"), []
    pack = pieces._pack
    monkeypatch.setattr(pieces, "_pack", lambda n: blocks.append(n) or pack(n))
    rows = [(k, "-" * (100 + k)) for k in range(30)]
    got = pieces.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), path, block_chars=500).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert blocks == [7] and sorted((x.id, tuple(x.ids), x.decoded) for x in got) == [(k, tuple(model.encode(t)), t) for k, t in rows]
