"""Splitting of oversized texts at natural boundaries.

A text is cut into ranges of ``RANGE_CHARS`` code points. Each range is scanned on its own, with a halo that holds the run
of white space or sentence marks that is open at its start, however long that is, and gives the table of the boundaries
inside it. The tables are stitched in the order of their ranges: the prefix sum of the range lengths turns local offsets
into offsets of the text, and cuts are planned as soon as the tables reach beyond the limit, so that a stitch holds no
more than one range and one limit of boundaries (``Stitch``). The pieces come out by offset. ``split_files`` does it with
byte ranges of files in shared storage: tables are made by any task, streamed through one stitch a file, and every
piece is read by offset, so that no task loads a file.

Boundaries, best first: 4 after a blank line, 3 after a line end, 2 after the end of a sentence, 1 before or after
white space. Only white space and the ends of Chinese or Japanese sentences (``。``, ``！``, ``？``) are natural
boundaries in the sense of the forced cases; a Latin sentence end needs the white space after it anyway.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.rows import distinct_rows
from corpusloom.sources import files

#: Code points of a range of a text.
RANGE_CHARS = 1 << 16
#: A better kind of boundary is taken if it fills a piece to at least this share of the limit.
FILL = 0.5

SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[。！？]|[.!?][\"”’')\]]*(?=\s)")
#: Ends of sentences that are natural boundaries without white space.
CJK_ENDS = "。！？"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if SPACE.match(c))
#: What a boundary at the start of a range can depend on, to the left of it.
OPEN = _SPACES + ".!?\"”’')]"


def boundaries(text: str, start: int, stop: int) -> tuple[list[int], list[int]]:
    """Positions (of ``text``) in ``(start, stop]`` where a piece may end, and their kinds.

    ``text`` holds the range ``[start, stop)`` and its halo: the open run to the left, one character to the right. Each
    run of white space gives a boundary after every of its characters, so that a cut can fall anywhere in a long run.
    """
    at: dict[int, int] = {}
    for m in SPACE.finditer(text):
        run = m.group()
        a, b = m.span()
        kind = 4 if run.count("\n") > 1 else 3 if "\n" in run or "\r" in run else 1
        for p in range(max(a, start + 1), min(b, stop) + 1):
            at[p] = max(at.get(p, 0), kind if p == b else 1)
    for m in SENTENCE.finditer(text):
        p = m.end()
        if start < p <= stop:
            at[p] = max(at.get(p, 0), 2)
        if m.group()[-1] not in CJK_ENDS and start < p + 1 <= stop:
            at[p + 1] = max(at.get(p + 1, 0), 2)
    keys = sorted(at)
    return keys, [at[p] for p in keys]


def open_run(read: Callable[[int, int], str], start: int) -> int:
    """How many characters before ``start`` belong to a run that is open there."""
    block = 16
    while True:
        text = read(max(0, start - block), start)
        left = len(text) - len(text.rstrip(OPEN))
        if left < len(text) or block >= start:
            return left
        block *= 4


class Stitch:
    """Stitches the boundary tables of a text, in order, and plans its pieces; holds a range and a limit of them at most.

    Each piece ends at the best boundary within its limit (see FILL), else at the limit (forced). The next one starts
    exactly ``overlap`` characters before that end, or less where it would not get on by at least one character.
    ``longest`` is the longest stretch without a boundary. ``floor`` moves a forced end and a start back to where a piece
    may end or start at all, ``widest`` apart at most; a limit that holds nothing of that kind is exceeded.
    """

    def __init__(self, limit: int, overlap: int, floor: Callable[[int], int] = int, widest: int = 1) -> None:
        self.limit, self.overlap, self.floor, self.widest = max(1, limit), max(0, overlap), floor, widest
        self.at: list[int] = []
        self.kind: list[int] = []
        self.base = self.begin = self.last = self.longest = self.number = 0
        self.over = False

    def feed(self, at: list[int], kind: list[int], size: int) -> list[tuple[int, int, int, bool]]:
        """The pieces (number, start, end, forced) that the next range of ``size`` characters settles."""
        for p in at:
            self.longest = max(self.longest, self.base + p - self.last)
            self.last = self.base + p
        self.at += [self.base + p for p in at]
        self.kind += kind
        self.base += size
        out = []
        while self.base - self.begin >= self.limit + self.widest:
            out.append(self._piece())
        drop = bisect_left(self.at, self.begin)
        del self.at[:drop], self.kind[:drop]
        return out

    def finish(self) -> list[tuple[int, int, int, bool]]:
        """The last pieces, at the end of the text."""
        self.longest = max(self.longest, self.base - self.last)
        out = []
        while self.base - self.begin > self.limit and not self.over:
            out.append(self._piece())
        return out if self.over else [*out, (self.number, self.begin, self.base, False)]

    def _after(self, position: int) -> int:
        """The first place beyond ``position`` where a piece may start."""
        x = position + 1
        while self.floor(x) <= position:
            x += 1
        return x

    def _piece(self) -> tuple[int, int, int, bool]:
        begin, at, kind = self.begin, self.at, self.kind
        lo = bisect_right(at, begin + min(self.overlap, self.limit - 1))  # a cut has to get beyond the overlap
        hi = bisect_right(at, begin + self.limit)
        cut, best, least = 0, 0, begin + self.limit * FILL
        for x in range(hi - 1, lo - 1, -1):
            if at[x] < least and best:
                break
            if kind[x] > best:
                cut, best = at[x], kind[x]
                if best == 4 or at[x] < least:
                    break
        end = cut if best else self.floor(begin + self.limit)
        if end <= begin:
            end = self._after(begin)
        piece = self.number, begin, end, not best
        self.number += 1
        self.begin = self.floor(max(0, end - self.overlap))
        if self.begin <= begin:
            self.begin = self._after(begin)
        self.over = end >= self.base  # only where the last piece had to exceed its limit
        return piece


def plan(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int, bool]], int]:
    """The pieces of a text and its longest stretch without a boundary, range by range."""
    stitch, out = Stitch(limit, overlap), []
    for start in range(0, len(text), RANGE_CHARS):
        stop = min(len(text), start + RANGE_CHARS)
        lead = open_run(lambda a, b: text[a:b], start)
        at, kind = boundaries(text[start - lead : stop + 1], lead, lead + stop - start)
        out += stitch.feed([p - lead for p in at], kind, stop - start)
    return out + stitch.finish(), stitch.longest


def with_limits(df: DataFrame, limits: DataFrame, section: str = "section") -> DataFrame:
    """``df`` with max_chars and overlap_chars by its section name; other and null sections take the row ``*``.

    Names are compared without letter case and outer white space. Of repeated limit rows of one name the lowest
    limit counts. A null or negative overlap is 0; without a row ``*`` other sections have no limit (null). The limits are
    a table of settings and become literals of the plan.
    """
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    rows = (
        limits.where("section IS NOT NULL AND max_chars > 0").select(name(F.col("section")).alias("name"), "max_chars", "overlap_chars")
        .groupBy("name").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("own")).collect()
    )
    known = {r["name"]: (r["own"]["max_chars"], max(0, r["own"]["overlap_chars"] or 0)) for r in rows}
    rest = known.pop("*", (None, 0))

    def of(i: int, kind: str):
        other = F.lit(rest[i]).cast(kind)
        if not known:
            return other
        table = F.create_map(*[F.lit(x) for k, v in sorted(known.items()) for x in (k, v[i])])
        return F.coalesce(F.try_element_at(table, F.coalesce(name(F.col(section)), F.lit(""))).cast(kind), other)

    return df.withColumns({"max_chars": of(0, "int"), "overlap_chars": of(1, "int")})


def oversize(df: DataFrame, limits: DataFrame, key: str, text: str, section: str) -> DataFrame:
    """``key``, section, text, max_chars, overlap_chars of the texts beyond their limit."""
    return with_limits(df.select(F.col(key).cast("string").alias(key), section, text), limits, section).where(F.char_length(text) > F.col("max_chars"))


def split(df: DataFrame, limits: DataFrame, key: str = "_id", text: str = "text", section: str = "section") -> DataFrame:
    """The pieces of all oversize texts: ``key``, row_key, section, piece number, start, end, forced, piece.

    Texts within their limit, null texts and texts without a limit give no row. Repeated rows count once; different
    texts of one key are split on their own (row_key tells them apart). Every piece has at most max_chars code
    points, and the pieces without their overlap put together are the text.
    """
    once = distinct_rows(oversize(df, limits, key, text, section).select(key, section, text)).select(
        key, F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key), F.lit("\x01")), F.coalesce(section, F.lit("\x01")), text), 256).alias("row_key"), section, text
    )
    rows = with_limits(once, limits, section)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                k, row, name, value, most, back = (c[0].as_py() for c in one.columns)
                pieces = plan(value, most, back)[0]
                for a in range(0, len(pieces), 1000):
                    part = pieces[a : a + 1000]
                    n, starts, ends, forced = zip(*part)
                    same = lambda x: pa.array([x] * len(part), pa.string())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [same(k), same(row), same(name), pa.array(n, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(forced, pa.bool_()), pa.array([value[x:y] for x, y in zip(starts, ends)], pa.string())],
                        names=[key, "row_key", section, "piece_no", "start", "end", "forced", "piece"],
                    )

    return rows.select(key, "row_key", section, text, "max_chars", "overlap_chars").mapInArrow(run, f"`{key}` string, row_key string, `{section}` string, piece_no int, start bigint, end bigint, forced boolean, piece string")


def found(df: DataFrame, limits: DataFrame) -> DataFrame:
    """``oversize`` and ``forced`` cases by corpus_id; only oversize texts leave the scan, and only ids the task."""
    rows = oversize(df.where("_id IS NOT NULL"), limits, "_id", "text", "section").select("_id", "text", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds = [], []
            for key, text, most, back in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(key)
                kinds.append("oversize")
                if plan(text, most, back)[1] > most:
                    keys.append(key)
                    kinds.append("forced")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string())], names=["corpus_id", "kind"])

    return rows.mapInArrow(run, "corpus_id string, kind string").distinct()


# Files: byte ranges, so that no task loads a whole file.

_ANY = lambda chars: b"(?:" + b"|".join(re.escape(c.encode()) for c in chars) + b")"
#: The patterns above on the bytes of UTF-8.
SPACE_BYTES, SPACES_BYTES = re.compile(_ANY(_SPACES)), re.compile(_ANY(_SPACES) + b"+")
SENTENCE_BYTES = re.compile(_ANY(CJK_ENDS) + b"|[.!?]" + _ANY("\"”’')]") + b"*(?=" + _ANY(_SPACES) + b")")


def byte_boundaries(data: bytes, start: int, stop: int) -> tuple[list[int], list[int]]:
    """``boundaries`` on UTF-8 bytes."""
    at: dict[int, int] = {}
    for m in SPACES_BYTES.finditer(data):
        run, b = m.group(), m.end()
        kind = 4 if run.count(b"\n") > 1 else 3 if b"\n" in run or b"\r" in run else 1
        at.setdefault(m.start(), 1)
        for one in SPACE_BYTES.finditer(data, *m.span()):
            at[one.end()] = max(at.get(one.end(), 0), kind if one.end() == b else 1)
    for m in SENTENCE_BYTES.finditer(data):
        p = m.end()
        at[p] = max(at.get(p, 0), 2)
        space = SPACE_BYTES.match(data, p)
        if m.group().decode("utf-8", "ignore")[-1:] not in CJK_ENDS and space:
            at[space.end()] = max(at.get(space.end(), 0), 2)
    keys = sorted(p for p in at if start < p <= stop)
    return keys, [at[p] for p in keys]


def character_start(read: Callable[[int, int], bytes], position: int) -> int:
    """The place of the UTF-8 character that holds the byte at ``position``; bytes that are no UTF-8 stand for themselves."""
    tail = read(max(0, position - 3), position + 1)
    if len(tail) < min(position, 3) + 1:  # the end of the file
        return position
    for back in range(min(position, 3) + 1):
        lead = tail[-1 - back]
        if lead & 0xC0 != 0x80:
            size = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            return position - back if back < size else position
    return position


def open_bytes(read: Callable[[int, int], bytes], start: int) -> int:
    """How many bytes before ``start`` belong to a run that is open there (see ``open_run``)."""
    block = 64
    while True:
        data = read(max(0, start - block), start)
        whole = character_start(lambda a, b: data[a:b], len(data) - 1) if data else 0
        text = data.decode("utf-8", "ignore")
        rest = text.rstrip(OPEN)
        left = len(text[len(rest) :].encode()) + (len(data) - whole if data and not data[whole:].decode("utf-8", "ignore") else 0)
        if rest or block >= start:
            return min(left, start)
        block *= 4


TABLES = "path string, part int, size bigint, at array<bigint>, kind array<int>"
CUTS = "path string, piece_no int, start bigint, end bigint, forced boolean"


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, range_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of UTF-8 files in shared storage: path, piece_no, start and end byte, forced, piece.

    Paths may be of any scheme that ``sources.files`` reads. ``limit`` and ``overlap`` are in bytes here, and cuts fall
    between characters only; with a forced cut in the middle of a character the piece ends before it, and a piece that
    would start in one starts before it. Ranges of ``range_bytes`` are scanned on their own, the tables of a file are
    streamed in order through one stitch, and each piece is read by offset.
    """
    spans = []
    for path in paths:
        size = files.size(path)
        spans += [(path, i, a, min(size, a + range_bytes)) for i, a in enumerate(range(0, max(size, 1), range_bytes))]
    ranges = spark.createDataFrame(spans, "path string, part int, start bigint, stop bigint")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                with files.reader(r.path) as read:
                    lead = open_bytes(read, r.start)
                    keys, kinds = byte_boundaries(read(r.start - lead, r.stop + 4), lead, lead + r.stop - r.start)
                yield pd.DataFrame({"path": [r.path], "part": [r.part], "size": [r.stop - r.start], "at": [[p - lead for p in keys]], "kind": [kinds]})

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, one, read, handle = None, None, None, None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([path] * len(pieces), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["path", "piece_no", "start", "end", "forced"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["path"] != path:
                    if one is not None:
                        yield rows(one.finish())
                        handle.__exit__(None, None, None)
                    path, handle = row["path"], files.reader(row["path"])
                    read = handle.__enter__()
                    one = Stitch(limit, overlap, lambda p: character_start(read, p), 4)  # noqa: B023
                yield rows(one.feed(row["at"], row["kind"], row["size"]))
        if one is not None:
            yield rows(one.finish())
            handle.__exit__(None, None, None)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                with files.reader(path) as read:
                    yield part.assign(piece=[read(a, b).decode("utf-8", "replace") for a, b in zip(part["start"], part["end"])])

    tables = ranges.repartition(max(1, len(spans)), "path", "part").mapInPandas(scan, TABLES)
    cuts = tables.repartition(max(1, min(len(paths), len(spans))), "path").sortWithinPartitions("path", "part").mapInArrow(stitch, CUTS)
    # pieces are dealt evenly before their bytes are read
    return cuts.repartition(max(1, len(spans)), "path", "piece_no").mapInPandas(emit, CUTS + ", piece string")
