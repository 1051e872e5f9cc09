"""Fill-in-the-middle texts: cuts between tokens are found by a parallel scan of an automaton.

The automaton reads UTF-8 bytes, says where a token begins and whether a marker has been seen. A chunk of bytes is read
from every state at once and gives a function of states and, for each state it may be entered in, the tokens that begin
in it. These compose associatively, so the state in which each chunk is entered and the tokens before it follow by
doubling; then only the chunks that hold a cut are read again. A document over ``GIANT`` bytes is dealt out as pieces
that are scanned apart, composed, and searched where its cuts lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .arrays import SPACE, chunks, flat_bytes
from .shared import materialise

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WIDTH = 256  # bytes that one state walks through
GIANT = 16 << 20  # bytes of a document that is scanned in pieces
PIECE = 1 << 20

BLANK, OPEN, LETTER, CLOSE, OTHER, PAD = range(6)  # classes of bytes; a pad leaves every state as it is
START, BLANKS, WORD = range(3)  # nothing read; in the blanks before a word; in a word
NONE, OPENED, NAMED, SEEN = range(4)  # how much of a marker has been read
STATES = 12


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and the tokens that begin, by 12 * class + state (4 * place in a token + part of a marker)."""
    following, begins = np.zeros((6, STATES), np.int64), np.zeros((6, STATES), np.int64)
    for kind in range(6):
        for state in range(STATES):
            place, mark = divmod(state, 4)
            if kind == PAD:
                following[kind, state] = state
                continue
            begins[kind, state] = place == START or (place == WORD and kind == BLANK)
            grown = {(OPENED, LETTER): NAMED, (NAMED, CLOSE): SEEN}.get((mark, kind), OPENED if kind == OPEN else NONE)
            following[kind, state] = 4 * (BLANKS if kind == BLANK else WORD) + (SEEN if mark == SEEN else grown)
    return following.ravel(), begins.ravel()


FOLLOWING, BEGINS = _automaton()
CLASS = np.full(256, OTHER, np.int64)
CLASS[SPACE] = BLANK
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE
CLASS[[ord(c) for c in "PSM"]] = LETTER
CLASS *= STATES


class Scan:
    """Texts (bytes end to end, row r from at[r] to at[r + 1]) in chunks: functions, counts and what they compose to."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        n_chunks = -(-np.diff(at) // WIDTH)
        self.first = np.append(0, np.cumsum(n_chunks))  # a row's first chunk
        self.row = np.repeat(np.arange(len(n_chunks)), n_chunks)
        self.begin = at[self.row] + (np.arange(self.first[-1]) - self.first[self.row]) * WIDTH
        self.end = np.minimum(self.begin + WIDTH, at[self.row + 1])
        n = len(self.row)
        self.states = np.broadcast_to(np.arange(STATES), (n, STATES))
        self.counts = np.zeros((n, STATES), np.int64)
        for kinds in self._steps(np.arange(n)):
            read = self.states + kinds[:, None]
            self.counts += BEGINS.take(read)
            self.states = FOLLOWING.take(read)
        self._compose()

    def _steps(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """The class of each next byte of these chunks."""
        size = self.end[which] - self.begin[which]
        for k in range(int(size.max(initial=0))):
            place = np.minimum(self.begin[which] + k, len(self.data) - 1)
            yield np.where(k < size, CLASS[self.data[place]], PAD * STATES)

    def _compose(self) -> None:
        """Each chunk's function and counts become those of all its row's bytes up to its end."""
        place, step = np.arange(len(self.row)) - self.first[self.row], 1
        while step < place.max(initial=0) + 1:
            later = np.flatnonzero(place >= step)
            before = self.states[later - step]
            counts = self.counts[later - step] + np.take_along_axis(self.counts[later], before, 1)
            states = np.take_along_axis(self.states[later], before, 1)
            self.states, self.counts = self.states.copy(), self.counts.copy()
            self.states[later], self.counts[later] = states, counts
            step *= 2

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The function and the counts of each row, whatever state it is entered in."""
        states, counts = np.tile(np.arange(STATES), (len(self.at) - 1, 1)), np.zeros((len(self.at) - 1, STATES), np.int64)
        filled = np.flatnonzero(np.diff(self.first))
        last = self.first[filled + 1] - 1
        states[filled], counts[filled] = self.states[last], self.counts[last]
        return states, counts

    def places(self, rows: np.ndarray, entered: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The byte, in all data, at which the nth token (from 0) that begins in the row begins, for rows that are
        entered in the given states; the row's end if fewer begin there."""
        out = self.at[rows + 1].copy()
        inside = np.flatnonzero(nth < self.rows()[1][rows, entered])
        rows, entered, nth = rows[inside], entered[inside], nth[inside]
        low, high = self.first[rows], self.first[rows + 1] - 1  # the first chunk up to whose end more than nth begin
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.counts[middle, entered] > nth
            low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
        headed = low > self.first[rows]
        state = np.where(headed, self.states[low - 1, entered], entered)
        left = nth - np.where(headed, self.counts[low - 1, entered], 0)
        found = np.full(len(low), -1)
        for k, kinds in enumerate(self._steps(low)):
            begins = BEGINS.take(state + kinds)
            found = np.where((found < 0) & (begins == 1) & (left == 0), k, found)
            left -= begins
            state = FOLLOWING.take(state + kinds)
        out[inside] = self.begin[low] + found
        return out

    def chars(self, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Code points between a row's begin and a place."""
        before = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
        return before[places] - before[self.at[rows]]


def _scan_texts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """n, the code points before the lower and the higher cut, and whether a marker is in the text."""
    out = []
    for part in chunks(pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"]), "text"):
        scan = Scan(*flat_bytes(part.column("text")))
        rows = np.arange(part.num_rows)
        states, counts = (x[:, START] for x in scan.rows())
        h1, h2 = (part.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2"))
        cuts = [cut(h1 % (counts + 1), h2 % (counts + 1)) for cut in (np.minimum, np.maximum)]
        low, high = (scan.chars(scan.places(rows, np.zeros_like(rows), c), rows) for c in cuts)
        out.append(pa.StructArray.from_arrays([pa.array(counts), pa.array(low), pa.array(high), pa.array(states % 4 == SEEN)], ["n", "low", "high", "marked"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("marked", pa.bool_())]))


def hashes(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the doc_id (a null one counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text as pieces of about ``size`` bytes, cut between characters."""
    for batch in batches:
        for r in range(batch.num_rows):
            data = batch.column("text")[r].as_buffer().to_pybytes()
            at = number = 0
            while at < len(data):
                end = min(at + size, len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                one = [batch.column(k).slice(r, 1) for k in ("its_key", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([*one, pa.array([number], pa.int32()), pa.array([data[at:end]], pa.binary())], ["its_key", "h1", "h2", "number", "piece"])
                at, number = end, number + 1


def _scan_piece(piece: pa.Array) -> pa.Array:
    out = []
    for text in piece:
        scan = Scan(*flat_bytes(pa.array([text.as_py()], pa.binary())))
        states, counts = scan.rows()
        out.append({"states": states[0].tolist(), "counts": counts[0].tolist(), "chars": int(scan.chars(scan.at[1:], np.zeros(1, np.int64))[0])})
    return pa.array(out, pa.struct([("states", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("chars", pa.int64())]))


ENTRY = pa.schema([("its_key", pa.string()), ("number", pa.int32()), ("is_high", pa.bool_()), ("entered", pa.int32()), ("nth", pa.int64()), ("chars_before", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_())])


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """Composes one document's pieces in order: the cuts in it, each with the piece that holds it, the state in which
    that is entered and the tokens and characters before it."""
    table = table.sort_by("number")
    h1, h2 = table.column("h1")[0].as_py(), table.column("h2")[0].as_py()
    states, counts = (np.array(table.column(k).to_pylist(), np.int64) for k in ("states", "counts"))
    entered, before = np.zeros(len(states), np.int64), np.zeros(len(states) + 1, np.int64)
    state = START
    for k in range(len(states)):
        entered[k], before[k + 1] = state, before[k] + counts[k, state]
        state = states[k, state]
    chars = np.append(0, np.cumsum(table.column("chars").to_numpy()))
    n = int(before[-1])
    rows = []
    for is_high, cut in enumerate(sorted((h1 % (n + 1), h2 % (n + 1)))):
        piece = int(np.searchsorted(before, cut, "right") - 1) if cut < n else len(states) - 1
        rows.append((key[0].as_py(), piece, bool(is_high), int(entered[piece]), cut - int(before[piece]), int(chars[piece]), n, bool(state % 4 == SEEN)))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENTRY.types, strict=True)], schema=ENTRY)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "piece"):
            scan = Scan(*flat_bytes(part.column("piece")))
            rows = np.arange(part.num_rows)
            entered, nth, before = (part.column(k).to_numpy().astype(np.int64) for k in ("entered", "nth", "chars_before"))
            place = before + scan.chars(scan.places(rows, entered, nth), rows)
            yield pa.RecordBatch.from_arrays([part.column("its_key"), part.column("is_high"), part.column("n"), part.column("marked"), pa.array(place)], ["its_key", "is_high", "n", "marked", "place"])


def giant_scans(giants: DataFrame, piece: int = PIECE) -> DataFrame:
    """its_key and scan (n, low, high, marked) of each document of ``giants`` (its_key, text, h1, h2), once for each key."""
    cut = giants.select("its_key", "text", "h1", "h2").mapInArrow(partial(_pieces, size=piece), "its_key string, h1 long, h2 long, number int, piece binary")
    pieces = materialise(cut.repartition("its_key", "number"), "pieces")
    scan_piece = arrow_udf(_scan_piece, "states array<int>, counts array<long>, chars long")
    scanned = pieces.select("its_key", "number", "h1", "h2", scan_piece("piece").alias("scan")).select("its_key", "number", "h1", "h2", "scan.*")
    entries = scanned.dropDuplicates(["its_key", "number"]).groupBy("its_key").applyInArrow(
        _entries, "its_key string, number int, is_high boolean, entered int, nth long, chars_before long, n long, marked boolean"
    )
    held = entries.join(pieces.select("its_key", "number", "piece"), ["its_key", "number"])
    places = held.mapInArrow(_locate, "its_key string, is_high boolean, n long, marked boolean, place long")
    place = lambda high: F.max(F.when(F.col("is_high") == high, F.col("place")))
    found = places.groupBy("its_key").agg(F.max("n").alias("n"), place(False).alias("low"), place(True).alias("high"), F.max("marked").alias("marked"))
    return found.select("its_key", F.struct("n", "low", "high", "marked").alias("scan"))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, giant: int = GIANT, piece: int = PIECE) -> DataFrame:
    """doc_id, text, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    A token is a word (characters other than 0x20 and 0x09 to 0x0D) with the blanks before it; blanks at the end are one.
    Four numbers from the seed and the doc_id decide: the first two the cuts, the third whether a document is changed (in
    ``rate`` of 100 cases), the fourth whether its suffix comes first (in ``suffix_first`` of 100 of these). Empty and
    null texts (n = 0) and texts that hold a marker stay plain. Rows are judged alone: repeated rows and rows of one
    doc_id are each transformed, a null doc_id counts as an empty one, other columns aren't read, an empty table gives an
    empty result. Texts over ``giant`` bytes are scanned in pieces of ``piece`` bytes, with the same results.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *hashes(seed))
    scan_texts = arrow_udf(_scan_texts, "n long, low long, high long, marked boolean")
    small = rows.where(F.octet_length("text") <= giant).withColumn("scan", scan_texts("text", "h1", "h2"))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    giants = materialise(rows.where(F.octet_length("text") > giant).withColumn("its_key", key), "giants")
    found = small if giants.isEmpty() else small.unionByName(giants.join(giant_scans(giants, piece), "its_key").select(*small.columns))
    found = found.select("doc_id", "text", "h3", "h4", "scan.*")
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    part = lambda begin, size: F.substr("text", (begin + 1).cast("int"), size.cast("int"))
    prefix, middle = part(F.lit(0), F.col("low")), part(F.col("low"), F.col("high") - F.col("low"))
    suffix = F.substr("text", (F.col("high") + 1).cast("int"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    changed = F.col("form") != "plain"
    return found.select("doc_id", "text", "n", "form", F.when(changed, F.col("low")).alias("prefix_chars"), F.when(changed, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its markers alone: a text that holds one is never changed, and each
    marker's first place is its own."""
    between = lambda begin, end: F.substr(output, F.locate(begin, output) + len(begin), F.locate(end, output) - F.locate(begin, output) - len(begin))
    after = lambda begin: F.substr(output, F.locate(begin, output) + len(begin))
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
