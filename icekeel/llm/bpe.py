"""BPE encoding and decoding with a distinct-word table.

Texts are split into words where no token of the tokenizer can cross. Every unit (a run of rows
of one task) numbers its distinct words and keeps each document as word numbers by position.
The words of all units meet in buckets by hash, where each distinct word is encoded once; the
ids go back to the units and are joined to the documents by position. Decoding joins ids to the
pieces of the vocabulary. Nothing wider than a word and a number is shuffled, so a word that
makes up a third of all text costs one row in each unit.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from icekeel.llm._common import batched, trim

#: Bytes of text in a unit (twice that where nothing is shuffled), of word numbers in a row, and ids in a batch that goes back to Spark.
UNIT_BYTES, ROW_WORDS, BATCH_IDS = 16 << 20, 1 << 18, 1 << 18
#: Bytes of text that are split together.
SPLIT_BYTES = 2 << 20
#: Bytes of text for each bucket of words: what one task reads doesn't grow with all of them.
BUCKET_BYTES = 128 << 20
#: Words whose ids a Python worker keeps for later units, at most.
KNOWN_WORDS = 500_000
#: All that some library takes for white space or might drop; cuts are only made away from these.
OTHERS = r"\x00-\x09\x0b-\x1f\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
SPACES = f" \n{OTHERS}"
#: Before a blank or a line end between two characters that are surely none, and after such a line end.
CUT = re.compile(f"(?<=[^{SPACES}])(?=[ \n][^{SPACES}])|(?<=[^{SPACES}]\n)(?=[^{SPACES}])")
#: Texts that only CUT splits: empty ones, those with other white space, and with blanks or line ends at an end or in a row.
ODD = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[" + re.sub(r"\\u(\w{4})", r"\\x{\1}", OTHERS) + "]"
#: Letters (as in a class of regexes) that stay single letters whatever a tokenizer makes of case and composition.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
TABLE = "dest long, unit long, kind int, seq long, ids array<long>, counts array<int>, blob binary, size long"


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _split(column: pa.Array, blanks: bool) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(order, words, sizes) of some texts, as for numbered()."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(column, ODD)
    plain = column.filter(pc.invert(odd))
    if blanks:
        plain = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
    else:
        plain = pc.replace_substring(plain, "\n", " ")
    lists = pc.split_pattern(plain, "\0" if blanks else " ")
    others = [CUT.split(t) if t else [] for t in column.filter(odd).to_pylist()]
    words = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array([w for ws in others for w in ws], pa.large_string())]).dictionary_encode()
    sizes = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(ws) for ws in others], np.int64)])
    at = odd.to_numpy(zero_copy_only=False)
    return np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)]), words, sizes


def numbered(column: pa.Array, blanks: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(order, words, numbers, sizes): the distinct words of texts, and each text's words by number.

    The texts come in another order: order has their places in column, sizes how many words each has.
    blanks: a blank belongs to the word after it, as byte-level BPE has it; otherwise white space
    between words is dropped, as by tokenizers that ignore it. Texts are split some SPLIT_BYTES at a time.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    order, words, sizes = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
    for first, last in chunks_of(np.concatenate([[0], ends]), SPLIT_BYTES):
        o, w, n = _split(column[first:last], blanks)
        order.append(o + first)
        words.append(w)
        sizes.append(n)
    if not words:
        return order[0], pa.array([], pa.large_string()), np.zeros(0, np.uint32), sizes[0]
    parts = pa.chunked_array(words).unify_dictionaries().chunks
    return np.concatenate(order), parts[0].dictionary, np.concatenate([x.indices.to_numpy().astype(np.uint32) for x in parts]), np.concatenate(sizes)


def units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows (doc_id, text) with some most bytes of text."""
    held, size = [], 0
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, before + most - size)) + 1)
            held.append(batch.slice(at, end - at))
            size, at = size + int(ends[end - 1]) - before, end
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks or [pa.array([], column.type)])


def _pack(parts: list[bytes]) -> tuple[bytes, int]:
    raw = b"".join(parts)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _planes(x: np.ndarray) -> list[bytes]:
    """An array below 2 ** 32 as its four byte planes, which compress far better than whole numbers."""
    return [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(4)]


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["dest", "unit", "kind", "seq", "ids", "counts", "blob", "size"])


def _numbered(blanks: bool, buckets: int, most: int):
    """docs -> rows of kind 1 (documents as word numbers, for dest unit) and kind 0 (a unit's words of one bucket, for dest bucket)."""

    def flush(unit: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, words, flat, sizes = numbered(_chunk(t.column(1)), blanks)
        ids = _chunk(t.column(0)).take(pa.array(rows))
        raw = words.cast(pa.large_binary()).to_pylist()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        # A word's final number: its place after sorting by frequency, so that numbers are small.
        order = np.argsort(-np.bincount(flat, minlength=len(raw)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        flat = rank[flat] if len(flat) else flat
        ends = np.concatenate([[0], np.cumsum(sizes)])
        start = seq = 0
        while start < len(sizes):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + ROW_WORDS, "right")) - 1)
            yield _batch([(unit, unit, 1, seq, ids[start:end].to_pylist(), sizes[start:end].tolist(), *_pack(_planes(flat[ends[start] : ends[end]])))])
            start, seq = end, seq + 1
        by = order[np.argsort(bucket[order], kind="stable")]
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in range(buckets):
            if len(own := by[edges[b] : edges[b + 1]]):
                held = [raw[i] for i in own]
                yield _batch([(b, unit, 0, b, None, None, *_pack([np.array([len(own)], "<u4").tobytes(), *_planes(rank[own]), *_planes(np.array([len(w) for w in held])), *held]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for unit, t in enumerate(units(batches, most), first):
            yield from flush(unit, t)
            t = None
            trim()

    return run


def _encoded(path: str):
    """Rows of kind 0, sorted by bucket -> their words replaced by ids, each distinct word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["seq"]):
            known: dict[bytes, np.ndarray] = {}
            for r in group:
                raw = _unpack(r["blob"], r["size"])
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                numbers, ends = raw[4 : 4 + 4 * n], np.cumsum(_from_planes(raw[4 + 4 * n : 4 + 8 * n])) + 4 + 8 * n
                words = [raw[a:b] for a, b in zip([4 + 8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                new = list(dict.fromkeys(w for w in words if w not in known))
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    for w, e in zip(part, tokenizer(path).encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, np.uint32)
                ids = [known[w] for w in words]
                flat = np.concatenate(ids)
                yield _batch([(r["unit"], r["unit"], 0, r["seq"], None, None, *_pack([np.array([n], "<u4").tobytes(), numbers, *_planes(np.array([len(x) for x in ids])), *_planes(flat)]))])

    return run


def _gathered(doc_ids: pa.Array, rows: np.ndarray, words: np.ndarray, table: np.ndarray, starts: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids) of texts with the words words[rows[k] : rows[k + 1]]; word w has the ids table[starts[w] :][: length[w]]."""
    per = length[words]
    edges = np.concatenate([[0], np.cumsum(per)])[rows]
    first = 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BATCH_IDS)) - 1)
        part = slice(rows[first], rows[last])
        own = per[part]
        at = np.arange(edges[last] - edges[first]) + np.repeat(starts[words[part]] - (np.cumsum(own) - own), own)
        lists = pa.ListArray.from_arrays(pa.array((edges[first : last + 1] - edges[first]).astype(np.int32)), pa.array(table[at]))
        yield pa.RecordBatch.from_arrays([doc_ids[first:last], lists], ["doc_id", "ids"])
        first = last


def _placed(docs: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
    """One unit's documents and its words' ids -> (doc_id, ids)."""
    numbers, sizes, ids = [], [], []
    for r in words.select(["blob", "size"]).to_pylist():
        raw = _unpack(r["blob"], r["size"])
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        numbers.append(_from_planes(raw[4 : 4 + 4 * n]))
        sizes.append(_from_planes(raw[4 + 4 * n : 4 + 8 * n]))
        ids.append(_from_planes(raw[4 + 8 * n :]))
    number, size = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (numbers, sizes))
    table = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    starts, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    starts[number], length[number] = np.cumsum(size.astype(np.int64)) - size, size
    for r in docs.sort_by("seq").select(["ids", "counts", "blob", "size"]).to_pylist():
        ends = np.concatenate([[0], np.cumsum(r["counts"])])
        yield from _gathered(pa.array(r["ids"], pa.int64()), ends, _from_planes(_unpack(r["blob"], r["size"])), table, starts, length)


def encode(docs: DataFrame, path: str, blanks: bool = True, id_col: str = "doc_id", text_col: str = "text", then=None, schema: str = "doc_id long, ids array<int>", unit_bytes: int = 0) -> DataFrame:
    """(doc_id, ids: array<int>) of every row of docs, as the tokenizers library encodes its whole text.

    path names the tokenizer's file on every executor; blanks tells whether its words start with
    the blank before them (byte-level BPE) or white space is dropped. Special tokens in a text are
    found as by the library; none are added. Null and empty texts give an empty array. Rows are
    independent: repeated rows repeat their result, null ids stay null. Other columns are ignored.
    then, a function of Arrow batches as for mapInArrow, is applied where the ids come into being; schema is its result's.
    """
    spark = docs.sparkSession
    narrow = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    # One shuffle serves both readers, which differ only above it: a filter with rand() stays there.
    rows = narrow.mapInArrow(_numbered(blanks, buckets, unit_bytes or UNIT_BYTES), TABLE).repartition(buckets, "dest")
    kind = F.col("kind") + F.rand(1)
    words = rows.filter(kind < 1).sortWithinPartitions("seq", "unit").mapInArrow(_encoded(path), TABLE)
    empty = spark.createDataFrame([], schema).schema

    def unit(docs: pa.Table, words: pa.Table) -> pa.Table:
        out = list(then(_placed(docs, words)) if then else _placed(docs, words))
        trim()
        return pa.Table.from_batches(out) if out else to_arrow_schema(empty).empty_table()

    return rows.filter(kind >= 1).groupBy("dest").cogroup(words.groupBy("dest")).applyInArrow(unit, schema)


def _parted(words: pa.Array, numbers: np.ndarray, rows: np.ndarray, tails: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words, numbers and rows (as for _gathered) after what words end in of tails is parted from a letter or digit before it."""
    stems = pc.utf8_rtrim(words, tails)
    cut = pc.and_(pc.match_substring_regex(stems, f"[0-9{LETTERS}]$"), pc.not_equal(stems, words))
    ends = pc.replace_substring_regex(words.filter(cut), f"(?s)^.*[^{re.escape(tails)}]", "")
    found = pa.concat_arrays([pc.if_else(cut, stems, words), ends]).dictionary_encode()
    index = found.indices.to_numpy().astype(np.int64)
    first, second = index[: len(words)], np.full(len(words), -1, np.int64)
    second[cut.to_numpy(zero_copy_only=False)] = index[len(words) :]
    tail = second[numbers]
    two = tail >= 0
    places = np.concatenate([[0], np.cumsum(two + 1)])
    out = np.empty(places[-1], np.int64)
    out[places[:-1]] = first[numbers]
    out[places[1:][two] - 1] = tail[two]
    return found.dictionary, out, places[rows]


@lru_cache(4)
def _enders(path: str) -> np.ndarray | None:
    """Which ids end a word, for a vocabulary that marks them."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark = model.get("end_of_word_suffix")
    if not mark:
        return None
    ids = [i for piece, i in model["vocab"].items() if piece.endswith(mark)]
    out = np.zeros(max(model["vocab"].values()) + 1, bool)
    out[ids] = True
    return out


@lru_cache(4)
def _lowers(path: str) -> bool:
    """Whether the tokenizer first lower-cases words of plain letters and changes nothing else about them: then case tells no words apart."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {}])
    kinds = {s.get("type") for s in steps if (s.get("type"), s.get("pattern")) != ("Replace", {"Regex": r"\s+"})}
    plain = pc.match_substring_regex(pa.array([t["content"] for t in spec["added_tokens"]], pa.string()), f"^[{LETTERS}]+$")
    return "Lowercase" in kinds and kinds <= {"Lowercase", "NFC"} and not pc.any(plain).as_py()


class _Known:
    """The ids of plain words that this process has encoded, KNOWN_WORDS at most: workers live on, and units share most words."""

    def __init__(self):
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = max(0, min(len(words), KNOWN_WORDS - len(self.words)))
        if n:
            self.words = pa.concat_arrays([self.words, words[:n]])
            self.ids, self.sizes = np.concatenate([self.ids, ids[: int(sizes[:n].sum())]]), np.concatenate([self.sizes, sizes[:n]])


@lru_cache(4)
def _known(path: str) -> _Known:
    return _Known()


def _ids_of(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths): the ids of every word, each encoded once.

    Where the vocabulary marks the ends of words, words of plain letters are encoded many at a time,
    parted by blanks, and told apart by those marks; those encoded before are looked up, and case is dropped where the tokenizer drops it.
    """
    ender, library, known = _enders(path), tokenizer(path), _known(path)
    plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False) if ender is not None else np.zeros(len(words), bool)
    own, others = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
    own = (pc.utf8_lower(own) if len(own) and _lowers(path) else own).dictionary_encode()
    place = pc.index_in(own.dictionary, value_set=known.words)
    new, place = own.dictionary.filter(place.is_null()), pc.fill_null(place, -1).to_numpy().astype(np.int64)
    place[place < 0] = len(known.words) + np.arange(len(new))
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def singly(part: pa.Array) -> None:
        found = [e.ids for e in library.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.int32))

    for at in range(0, len(new), 1 << 14):
        part = new[at : at + (1 << 14)]
        listed = part.to_pylist()
        joined = [" ".join(listed[k : k + 256]) for k in range(0, len(listed), 256)]
        for k, e in enumerate(library.encode_batch_fast(joined, add_special_tokens=False)):
            flat, size = np.array(e.ids, np.int32), min(256, len(part) - 256 * k)
            ends = np.flatnonzero(ender[np.minimum(flat, len(ender) - 1)]) + 1
            if len(ends) == size:
                ids.append(flat)
                sizes.append(np.diff(ends, prepend=0))
            else:
                singly(part[256 * k : 256 * k + size])
    fresh = np.concatenate(ids), np.concatenate(sizes)
    ids, sizes = [known.ids, fresh[0]], [known.sizes, fresh[1]]
    rows = np.empty(len(words), np.int64)
    rows[plain], rows[~plain] = place[own.indices.to_numpy()], len(known.words) + len(new) + np.arange(len(others))
    known.add(new, *fresh)
    for at in range(0, len(others), 4096):
        singly(others[at : at + 4096])
    sizes = np.concatenate(sizes)
    return np.concatenate(ids), (np.cumsum(sizes) - sizes)[rows], sizes[rows]


def encode_by_unit(docs: DataFrame, path: str, blanks: bool = True, tails: str = "", then=None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """encode() of docs (doc_id, text) without a shuffle: each unit encodes its own distinct words.

    tails: characters in no special token that the tokenizer parts from a Latin letter or digit before them; words count without them.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches, 2 * UNIT_BYTES):
            order, words, numbers, sizes = numbered(_chunk(t.column(1)), blanks)
            doc_ids, t = _chunk(t.column(0)).take(pa.array(order)), None
            rows = np.concatenate([[0], np.cumsum(sizes)])
            if tails:
                words, numbers, rows = _parted(words, numbers, rows, tails)
            yield from _gathered(doc_ids, rows, numbers, *_ids_of(words, path))
            words = numbers = None
            trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(encoded(batches)) if then else encoded(batches)

    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    table = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [bytes(char[c] for c in p) if all(c in char for c in p) else p.encode() for p in (table.get(i, "") for i in range(max(table) + 1))]


class Pieces:
    """The small side of a join of ids to byte strings: flat arrays, to which whole batches are joined by position."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(p) for p in table] + [0], np.int64)
        self.start, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(table), np.uint8)

    def joined(self, lists: pa.ListArray) -> Iterator[bytes | None]:
        """For each list of ids the pieces of its ids; an id that isn't there gives nothing."""
        edges, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
        for first, last in chunks_of(edges, BATCH_IDS):
            ids = lists.values.to_numpy()[edges[first] : edges[last]]
            ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size) - 1, ids)
            size = self.size[ids]
            ends = np.concatenate([[0], np.cumsum(size)])
            raw = self.raw[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes()
            cuts = ends[edges[first : last + 1] - edges[first]].tolist()
            for k in range(last - first):
                yield raw[cuts[k] : cuts[k + 1]] if valid[first + k] else None


def chunks_of(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of lists with some most values together; a longer list is a range of its own."""
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, "right")) - 1)
        yield first, last
        first = last


@lru_cache(4)
def vocabulary(path: str) -> Pieces:
    return Pieces(pieces(path))


def _utf8(raw: bytes) -> bytes:
    """raw as the UTF-8 of the text that it decodes to, invalid bytes replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def _texts(lists: pa.ListArray, path: str) -> pa.Array:
    return pa.array([raw if raw is None else raw.decode("utf-8", "replace") for raw in vocabulary(path).joined(lists)], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column text: the pieces of ids, joined, as UTF-8 with invalid bytes replaced.

    The vocabulary of the file is the small side of the join of ids to pieces, which every task holds: its size is fixed.
    Null ids give a null text, an empty array an empty one; special tokens are kept; other columns
    stay. An id outside the vocabulary gives nothing.
    """
    columns = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), _texts(batch.column("ids"), path)], [*columns, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*columns).schema)
    return encoded.select(*columns).mapInArrow(run, f"{schema}, text string")


def with_text(path: str):
    """For encode(then=...): decodes where the ids come into being. The schema is doc_id long, ids array<int>, text string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), _texts(batch.column("ids"), path)], ["doc_id", "ids", "text"])

    return run


#: The schema of digests().
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str):
    """For encode(then=...): the number of ids, and digests of the decimal ids joined by commas and of the text that they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, size = [x.split()[0] for x in DIGESTS.split(", ")], len(pieces(path))
        decimal = Pieces([f"{i},".encode() for i in range(size)])
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.cast(pc.list_value_length(lists), pa.int64())
            by_ids = [hashlib.sha256(raw[:-1]).hexdigest() for raw in decimal.joined(lists)]
            by_text = [hashlib.sha256(_utf8(raw)).hexdigest() for raw in vocabulary(path).joined(lists)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], names)

    return run
