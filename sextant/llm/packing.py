"""Harmonic packing: documents as tokens, cut to reciprocal classes of a sequence's capacity, a fixed number of pieces to a bin."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import kept, materialise, pieces, text_of

#: Chunks whose ids a worker remembers at most, about 150 MB; then it forgets the newer half: what is frequent came early.
REMEMBERED = 500_000
#: Leftover pieces that one task closes at most; more are dealt to several first.
LAST = 200_000
MARK = "\x01"
LATIN = re.compile("[\x00-\xff]*+")
STOP = re.compile(r"[.,](?<=[a-zà-öø-ÿ].)(?= |$)")


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit bytes.

    Only for tokenizers whose tokens never reach across a space or a newline and which drop both: then a text's ids are those of its
    chunks, one after the other, and each chunk needs to be encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: struct.pack("<I", k) for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special and re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.special_ids = special
        self.tokenizer.encode_special_tokens = True  # they are cut out before; what lower case makes look like one is text
        self.known: dict[str, bytes] = {"": b""}
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.between = f" {MARK} "

    def learn(self, chunks: set[str]) -> None:
        """Ids of new chunks: many chunks make one text, with a mark between them whose one id comes from nothing else."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        new = []
        for chunk in chunks:
            if MARK in chunk:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
                self.known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                new.append(chunk)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode(self.between.join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            starts = [0, *(4 * ends + 4).tolist()]
            flat = ids.tobytes()
            self.known.update(zip(part, map(flat.__getitem__, map(slice, starts, [*(4 * ends).tolist(), len(flat)])), strict=True))

    def encode(self, text: str) -> bytes:
        if self.special and len(cut := self.special.split(text)) > 1:
            return b"".join(self.special_ids[x] if k % 2 else self._plain(x) for k, x in enumerate(cut))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        text = text.replace("\n", " ")
        if LATIN.fullmatch(text):  # lower case goes by single letters there, and a mark after a letter is a token of its own: fewer chunks differ
            text = STOP.sub(r" \g<0>", text.lower())
        chunks = text.split(" ")
        if new := set(chunks).difference(self.known):
            self.learn(new)
            if missed := set(chunks).difference(self.known):  # forgotten just now
                self.learn(missed)
        return b"".join(map(self.known.__getitem__, chunks))


def encoder(name: str) -> ChunkEncoder:
    """The worker's encoder, which lasts until another operator's task comes to the worker."""
    import public_tokenizers

    return kept(f"encoder of {name}", lambda: ChunkEncoder(public_tokenizers.path(name)))


def cuts(n: int, capacity: int, waste: float) -> list[int]:
    """The lengths of the pieces of ``n`` tokens: full sequences, then what fills a slot of its class but for ``waste`` of the bin.

    Class j holds lengths over capacity/(j+1), up to capacity/j, so j of them fit a bin. A rest that would leave more than ``waste``
    of its bin empty gives a piece of exactly the next class's slot, and what then remains is looked at again.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        take = rest if j * rest >= (1 - waste) * capacity else capacity // (j + 1)
        out.append(take)
        rest -= take
    return out


def fill(worker: int, capacity: int) -> Callable[[list], tuple[list, list]]:
    """A function that takes pieces (length first) and returns those whose bins are now full, with sequence and offset; at None, what is left."""
    bins: dict[int, list] = {}
    made = 0

    def put(found: list | None) -> list:
        nonlocal made
        if found is None:
            return [x for waiting in bins.values() for x in waiting]
        done = []
        for piece in found:
            j = capacity // piece[0]
            waiting = bins.setdefault(j, [])
            waiting.append(piece)
            if len(waiting) == j:
                at = 0
                for x in waiting:
                    done.append((x, (worker << 32) + made, at))
                    at += x[0]
                made += 1
                waiting.clear()
        return done

    return put


def close(found: list, capacity: int, worker: int) -> list:
    """All pieces in bins, the largest first, each where it fits most tightly."""
    room: list[int] = []  # what is free in some bin, in order
    by_room: dict[int, list[list]] = {}
    all_bins: list[list] = []
    for piece in sorted(found, key=lambda x: -x[0]):
        k = bisect_left(room, piece[0])
        if k < len(room):
            free = room[k]
            own = by_room[free].pop()
            if not by_room[free]:
                room.pop(k)
        else:
            free, own = capacity, []
            all_bins.append(own)
        own.append(piece)
        free -= piece[0]
        if free:
            if not by_room.get(free):
                insort(room, free)
            by_room.setdefault(free, []).append(own)
    done = []
    for made, own in enumerate(all_bins):
        at = 0
        for x in own:
            done.append((x, (worker << 32) + made, at))
            at += x[0]
    return done


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of ((length, doc_id, start, crc, doc_tokens, ids), sequence, offset)."""
    columns = list(zip(*((*x, s, o) for x, s, o in rows), strict=True)) if rows else [[]] * 8
    length, doc, start, crc, total, ids, sequence, offset = columns
    by = {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "sequence_id": sequence, "offset": offset, "ids": ids}
    return pa.RecordBatch.from_arrays([pa.array(by[f.name], f.type) for f in schema], schema=schema)


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", end: int = 1, capacity: int = 2048, waste: float = 0.03, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text): where its tokens stand in which sequence.

    Each document's ids, then ``end``; null and empty texts are the ``end`` alone, and repeated rows are documents of their own.
    Every id lies in exactly one piece; an empty table gives no rows. A sequence has pieces of one class, ``capacity``//length of
    them, and padding of ``waste`` of it at most; the few pieces that no worker could fill a bin with are dealt out again, and the
    last of them fitted by size. Other columns of ``docs`` are not used. With ``keep_ids``, a column ``ids`` has the ids
    themselves, as little-endian 32-bit numbers. Sequence numbers are unique, not dense.
    """
    docs = docs.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "ids": "binary"}
    ddl = ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names)
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([(n, {"doc_id": doc_type, "ids": pa.binary()}.get(n, pa.int64())) for n in names])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        tail = struct.pack("<I", end)
        put = fill(TaskContext.get().partitionId(), capacity)
        for batch in pieces(batches, "text", uses=f"encoder of {tokenizer}"):
            done = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_of(batch.column("text")), strict=True):
                ids = encode(text) + tail
                n, at, found = len(ids) // 4, 0, []
                for size in cuts(n, capacity, waste):
                    own = ids[4 * at : 4 * (at + size)]
                    found.append((size, doc, at, zlib.crc32(own), n, own if keep_ids else None))
                    at += size
                done += put(found)
            yield _batch(done, schema)
        yield _batch([(x, None, None) for x in put(None)], schema)

    def again(level: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = (level << 26) + TaskContext.get().partitionId()
            put, rest = fill(worker, capacity), []
            for batch in batches:
                by = [batch.column(n).to_pylist() for n in ("length", "doc_id", "start", "ids_crc32", "doc_tokens")]
                found = list(zip(*by, batch.column("ids").to_pylist() if keep_ids else [None] * batch.num_rows, strict=True))
                if last:
                    rest += found
                else:
                    yield _batch(put(found), schema)
            yield _batch(close(rest, capacity, worker) if last else [(x, None, None) for x in put(None)], schema)

        return run

    level, before, out = 0, None, materialise(docs.mapInArrow(first, ddl))
    whole, rest = out.where("sequence_id is not null"), out.where("sequence_id is null")
    while True:
        level += 1
        left = rest.count()
        groups = max(1, -(-left // LAST))
        if groups == 1 or before is not None and left > before / 2:  # few enough, or no longer fewer: fit them by size
            return whole.unionByName(rest.repartition(groups).mapInArrow(again(level, True), ddl))
        before, out = left, materialise(rest.repartition(groups).mapInArrow(again(level, False), ddl))
        whole, rest = whole.unionByName(out.where("sequence_id is not null")), out.where("sequence_id is null")


def padding(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the share of padding, with sequences padded to ``capacity`` except at a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    full = F.when(F.expr("used & (used - 1)") == 0, F.col("used")).otherwise(F.lit(capacity))
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), (1 - F.sum("used") / F.sum(full)).alias("padding"))
