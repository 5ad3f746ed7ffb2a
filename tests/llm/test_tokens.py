"""Encoding, counts and token files against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from odd_documents import no_docs, odd_docs, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from doclake.llm import encoders, piece_transducer, token_counts, token_files
from doclake.session import new_shared_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
hf = Tokenizer.from_file(WORDS)

TEXT = st.text(alphabet="aB e.\n é▁<'1Σ́\tthe in,;日本\0", max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    want = [encoders.pack(sp.encode(t)) for t in texts]
    assert encoders.load(PIECES).encode(texts) == want
    assert piece_transducer.load(PIECES).encode(texts) == want
    assert encoders.load(WORDS).encode(texts) == [encoders.pack(hf.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258)), max_size=12))
def test_decoding_any_ids(ids):
    assert piece_transducer.load(PIECES).decode(ids) == sp.decode(ids)


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(encoders, "SEGMENT_CHARS", 40)
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "of", "a1", "zürich", "x,", "  ", "\n"]) for _ in range(3000))
    for encoder, want in ((encoders.load(PIECES), sp.encode(text)), (encoders.load(WORDS), hf.encode(text, add_special_tokens=False).ids)):
        assert encoder.encode([text]) == [encoders.pack(want)]
    assert piece_transducer.load(PIECES).encode([text]) == [encoders.pack(sp.encode(text))]


def test_pieces_of_older_generations():
    encoder = encoders.JsonEncoder(WORDS)
    encoder.numbered_pieces = 5
    rng = random.Random(3)
    words = ["the", "The,", "of", "a1", "zürich", "x,", "", "\n", "1999", "don't", "é.", "▁"]
    for _ in range(30):
        texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(4)]
        assert encoder.encode(texts) == [encoders.pack(hf.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.encode([]) == [] and encoder.encode(["", "the"])[0] == b""


def test_unigram_file_is_a_shortest_path():
    """A small file put together by hand, compared with the library's own search."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    del model.pieces[259:]
    rng = random.Random(4)
    spelled = {"▁"} | {"".join(rng.choice("abc▁" if k == 0 else "abc") for k in range(n)) for n in (1, 2, 3, 4) for _ in range(12)}
    for piece in sorted(spelled):
        model.pieces.add(piece=piece, score=-rng.uniform(1, 9), type=1)
    model.trainer_spec.model_type = 1
    model.trainer_spec.vocab_size = len(model.pieces)
    data = model.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    machine = piece_transducer.Transducer(data)
    for _ in range(400):
        text = "".join(rng.choice("abc  é") for _ in range(rng.randint(0, 25)))
        assert machine.encode([text]) == [encoders.pack(library.encode(text))], text


def test_counts_of_odd_documents(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, token_counts.token_counts(odd_docs, PIECES, limit=50).collect()), key=repr)
    want = []
    for i, t in odd_rows:
        n = len(sp.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 50))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_encoding_of_odd_documents(odd_docs, odd_rows, no_docs):
    got = piece_transducer.encode(odd_docs, PIECES).collect()
    want = {}
    for i, t in odd_rows:
        want.setdefault(i, []).append((sp.encode(t or ""), zlib.crc32(sp.decode(sp.encode(t or "")).encode())))
    assert len(got) == len(odd_rows)
    for row in got:
        assert (row["ids"], row["decoded_crc32"]) in want[row["doc_id"]]
        assert row["n_tokens"] == len(row["ids"]) and row["round_trip"]
    assert piece_transducer.encode(no_docs, PIECES).count() == 0


def test_token_files_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    path = new_shared_path(spark, "tokens")
    token_files.write_tokens(odd_docs, path, WORDS, 2)
    files = token_files.read_tokens(spark, path)
    offsets = token_files.shard_offsets(files)
    rows = token_files.with_offsets(token_files.checksums(files), offsets).orderBy("start").collect()
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for row, (i, text) in zip(rows, ordered, strict=True):
        ids = hf.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (i, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(encoders.pack(ids))
        start += len(ids)
    # The ids of one document, and the counts of all, without the rest of the files.
    one = files.where("doc_id = 7").select("ids")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "n_tokens" not in plan.split("ReadSchema")[1]
    assert one.first()["ids"] == hf.encode(dict(odd_rows)[7], add_special_tokens=False).ids + [2]
    empty = new_shared_path(spark, "tokens")
    token_files.write_tokens(no_docs, empty, WORDS, 2)
    assert token_files.read_tokens(spark, empty).count() == 0
    assert token_files.shard_offsets(token_files.read_tokens(spark, empty)).count() == 0


def test_token_file_format(spark, odd_docs):
    """Dictionary or delta encoding, bounded pages and page indexes are in the files."""
    import glob

    import pyarrow.parquet as pq

    path = new_shared_path(spark, "tokens")
    token_files.write_tokens(odd_docs, path, WORDS, 2)
    seen = set()
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for group in range(meta.num_row_groups):
            for column in range(meta.num_columns):
                chunk = meta.row_group(group).column(column)
                seen.add((chunk.path_in_schema.split(".")[0], *sorted(chunk.encodings)))
                assert chunk.has_offset_index and chunk.has_column_index
    assert any(c[0] == "ids" and any("DICTIONARY" in e for e in c[1:]) for c in seen)
    assert any(c[0] == "doc_id" and "DELTA_BINARY_PACKED" in c[1:] for c in seen)
