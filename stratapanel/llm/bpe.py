"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary is turned into a sentencepiece BPE model directly: each byte string becomes a piece of
byte-mapped characters whose score is its negative rank, and the normaliser is the identity. A text is cut by
the pre-token pattern; a pre-token that is a vocabulary entry is that entry, any other is encoded by the model.
Decoding maps ids back to their byte strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import short_batches

#: Pre-tokens kept with their ids by each worker; beyond that the memo starts anew.
MEMO_ENTRIES = 400_000
#: Longer pre-tokens are encoded each time they occur.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(0x100 + rest.index(b)) for b in range(256)]


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; a piece's id is its place in rank order, the unknown piece is last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars, model = byte_characters(), pb.ModelProto()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(chars[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = pb.TrainerSpec.BPE, len(model.pieces), len(model.pieces) - 1
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    normal = model.normalizer_spec
    normal.name, normal.precompiled_charsmap = "identity", b""
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes pre-tokens and decodes ids; one per worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.ranks, self.by_rank = ranks, sorted(ranks.values())
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.by_rank}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = dict(enumerate(byte_characters()))
        self.memo: dict[str, tuple[int, ...]] = {}

    def learn(self, tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each pre-token."""
        found, rest = {}, []
        for token in tokens:
            rank = self.ranks.get(token.encode())
            if rank is None:
                rest.append(token)
            else:
                found[token] = (rank,)
        if rest:
            mapped = [token.encode().decode("latin-1").translate(self.chars) for token in rest]
            for token, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                found[token] = tuple(self.by_rank[i] for i in ids)
        return found

    def encode(self, text: str) -> list[int]:
        tokens, memo = self.cut(text), self.memo
        try:
            return list(chain.from_iterable([memo[token] for token in tokens]))
        except KeyError:
            pass
        new = self.learn(set(tokens).difference(memo))
        kept = {token: ids for token, ids in new.items() if len(token) <= MEMO_CHARS}
        if len(memo) + len(kept) > MEMO_ENTRIES:
            memo.clear()
            new = self.learn(set(tokens))
            kept = {token: ids for token, ids in new.items() if len(token) <= MEMO_CHARS}
        ids = list(chain.from_iterable([memo[token] if token in memo else new[token] for token in tokens]))
        if len(kept) <= MEMO_ENTRIES:
            memo.update(kept)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(shared, key: tuple[str, str]) -> Codec:
    """The worker's codec for a (model digest, pattern)."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value, key[1])
    return _CODECS[key]


def _shared(docs: DataFrame, path: str, pattern: str):
    """The vocabulary, whose file bounds its size, for all workers; and its key."""
    ranks = read_ranks(path)
    model = model_bytes(ranks)
    return docs.sparkSession.sparkContext.broadcast((ranks, model)), (hashlib.sha256(model).hexdigest(), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text; a null or empty text has no ids.

    Rows are independent: repeated rows give repeated results, other columns are ignored, an empty table gives
    an empty result. Bytes that are no UTF-8 are read as U+FFFD.
    """
    short_batches(docs.sparkSession)
    shared, key = _shared(docs, path, pattern)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        for batch in batches:
            ids = [codec.encode((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of every list of ids; a null list gives no bytes. Ids outside the vocabulary are an error."""
    shared, key = _shared(encoded, path, pattern)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        for batch in batches:
            out = [codec.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass.

    The id list never leaves the worker, which spares an Arrow column several times the text's size. Nulls,
    repeats and other columns are as for ``encode``.
    """
    short_batches(docs.sparkSession)
    shared, key = _shared(docs, path, pattern)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        digits = codec.digits.__getitem__
        for batch in batches:
            n, encoded, decoded = [], [], []
            for x in batch.column(1):
                ids = codec.encode((x.as_py() or b"").decode("utf-8", "replace"))
                n.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
