"""Token ids and the row format of packed sequences."""

import base64
import functools

import numpy as np
import pyarrow as pa

SEQUENCE = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, pieces array<struct<doc_id:{id},start:long,length:long,offset:long,doc_tokens:long>>"

#: The added tokens of byte_bpe_50k.json; its rank file has none.
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(4)
def encoder(path):
    """text -> list of ids.  A .tiktoken file holds the ranks of the same vocabulary as the
    .json file of that name and is several times faster; a .json file works too.  Text that
    holds a special token's string has its id there, as the plain tokenizers call gives it."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: own.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else own.encode_ordinary(text)


def document_ids(text, encode, end_id):
    ids = encode(text) if text else []
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


class Writer:
    """Gathers finished sequences into Arrow batches of a bounded size."""

    def __init__(self, first_id, length, pad_id, id_type, most=512, bare_powers=False):
        """bare_powers: a sequence whose number of ids is a power of two is not padded."""
        self.next, self.length, self.pad, self.id_type, self.most, self.bare_powers = first_id, length, pad_id, id_type, most, bare_powers
        self.rows = []

    def add(self, pieces):
        """pieces: (doc_id, start, ids, doc_tokens) in order; they fill one sequence."""
        used = sum(len(p[2]) for p in pieces)
        size = used if self.bare_powers and used & (used - 1) == 0 else self.length
        row, pos, cum, told, at = np.full(size, self.pad, "<u4"), np.zeros(size, "<u4"), [0], [], 0
        for doc, start, ids, total in pieces:
            n = len(ids)
            row[at : at + n] = ids
            pos[at : at + n] = np.arange(n)
            told.append({"doc_id": doc, "start": start, "length": n, "offset": at, "doc_tokens": total})
            at += n
            cum.append(at)
        self.rows.append((self.next, at, row.tobytes(), pos.tobytes(), cum, told))
        self.next += 1

    def full(self):
        return len(self.rows) >= self.most

    def take(self):
        cols, self.rows = list(zip(*self.rows)) or [()] * 6, []
        piece = pa.struct([("doc_id", self.id_type), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(piece)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "pieces"])


def pieces_of(packed):
    """One row for each piece, with the CRC-32 of its ids as they stand in the matrix."""
    from pyspark.sql import functions as F

    p = packed.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    return p.select(
        "p.doc_id", "p.start", "p.length",
        F.crc32(F.expr("substring(input_ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))")).alias("ids_crc32"),
        "p.doc_tokens", "sequence_id", "p.offset",
    )


def write_packed(packed, path):
    """Writes the matrix rows (little-endian unsigned 32-bit ids and positions, cumulative
    segment lengths) as Parquet at `path`, on whatever store Spark writes to."""
    packed.write.mode("errorifexists").parquet(path)
