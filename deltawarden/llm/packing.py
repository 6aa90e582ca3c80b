"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem of any corpus is its histogram of lengths: at
most ``capacity`` rows. The search runs on that histogram and yields fillings with a multiplicity; the pieces are
then dealt into the fillings by their rank within their length, which is counted in salted parts.

Search: take the largest piece left, list the fillings of the rest of its sequence, least waste first, and branch over
them. Sums that the remaining lengths can reach, held as bits of one number per length, lead to every filling without
a dead end. A filling is left out if a piece would still fit, or if another one dominates it (its pieces can be grouped
into the other's pieces). A branch uses a filling as often as it goes, or once. It ends when its waste leaves no room
to beat the best packing known. Best-fit decreasing gives that packing at the start and completes branches as long as
completing has taken no more work than branching, so there is a whole packing at any time.

The search is the same at every size. ``max_steps`` bounds its elementary steps on the driver, ``width`` the fillings
listed at a branch; neither depends on the clock, so reruns agree. The packing is known to be minimal when it meets
the lower bound, or when the search runs out and no list was cut; otherwise the best one found is returned.

Defined results: a null or empty text is one piece that holds the separator alone; repeated rows are packed like any
others; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltawarden.llm.common import whole_text
from deltawarden.llm.tokens import text_ids, word_ids
from deltawarden.session import cut_lineage

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


@dataclass
class Work:
    """Elementary steps taken; ``most`` ends a search."""

    most: int
    steps: int = 0


def best_fit(counts: dict[int, int], capacity: int, work: Work | None = None) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over a histogram: (sequences, what each holds)."""
    work = work or Work(0)
    open_groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left -> (sequences, {length: copies})
    rooms: list[int] = []  # sorted keys of open_groups

    def put(room: int, many: int, holds: dict[int, int]) -> None:
        if room not in open_groups:
            open_groups[room] = []
            insort(rooms, room)
        open_groups[room].append((many, holds))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            work.steps += 4
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                many, rest = divmod(left, per)
                if many:
                    put(capacity - per * length, many, {length: per})
                if rest:
                    put(capacity - rest * length, 1, {length: rest})
                break
            room = rooms[at]
            open_many, holds = open_groups[room].pop()
            per = room // length
            many = min(open_many, left // per)
            taken, added = (many, per) if many else (1, left)
            if open_many > taken:
                open_groups[room].append((open_many - taken, holds))
            if not open_groups[room]:
                del open_groups[room]
                rooms.pop(at)
            put(room - added * length, taken, {**holds, length: holds.get(length, 0) + added})
            left -= taken * added
    return [(many, tuple(sorted(holds.items(), reverse=True)))
            for groups in open_groups.values() for many, holds in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the larger of total size and, for each small size a, what pieces above
    capacity - a (alone) and above half (no two together) force, plus the rest of the pieces of a and more."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    many = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    best = math.ceil(int((sizes * many).sum()) / capacity)
    for a in [0, *[int(s) for s in sizes if 2 * s <= capacity]]:
        alone = sizes > capacity - a
        large = (2 * sizes > capacity) & ~alone
        middle = (sizes >= a) & (2 * sizes <= capacity)
        n_large = int(many[large].sum())
        room = n_large * capacity - int((sizes * many)[large].sum())
        extra = int((sizes * many)[middle].sum()) - room
        best = max(best, int(many[alone].sum()) + n_large + max(0, math.ceil(extra / capacity)))
    return best


def _fits_into(small: list[int], rooms: list[int], work: Work) -> bool:
    """Whether the pieces can be grouped into the given rooms. Undecided within the steps allowed counts as no."""
    if not small:
        return True
    head, tried = small[0], set()
    for i, room in enumerate(rooms):
        if work.steps >= work.most:
            return False
        work.steps += 1
        if room >= head and room not in tried:
            tried.add(room)
            if _fits_into(small[1:], rooms[:i] + [room - head] + rooms[i + 1:], work):
                return True
    return False


def _spelled(filling: Filling) -> list[int]:
    return [length for length, copies in filling for _ in range(copies)]


def _reachable(lengths: list[int], counts: dict[int, int], room: int, work: Work) -> list[int]:
    """For each place in the list the sums up to the room that lengths from there on reach, as bits of a number."""
    mask, sums = (1 << (room + 1)) - 1, [1]
    for length in reversed(lengths):
        bits, copies, many = sums[-1], min(counts[length], room // length), 1
        while copies:  # 1, 2, 4 ... copies at once make every number of copies
            step = min(many, copies)
            bits |= bits << (step * length) & mask
            copies, many = copies - step, 2 * many
            work.steps += 1
        sums.append(bits)
    return sums[::-1]


def list_fillings(counts: dict[int, int], room: int, max_waste: int, work: Work) -> Iterator[Filling]:
    """Undominated fillings of the room, least waste first; no filling wastes more than max_waste."""
    if counts.get(room):
        yield ((room, 1),)  # a piece that fills the room dominates every other filling
        return
    lengths = [s for s in sorted(counts, reverse=True) if s <= room and counts[s]]
    sums = _reachable(lengths, counts, room, work)
    kept: list[list[int]] = []

    def fill(start: int, left: int, held: Filling) -> Iterator[Filling]:
        if not left:
            yield held
            return
        for i in range(start, len(lengths)):
            work.steps += 1
            if work.steps >= work.most or not sums[i] >> left & 1:
                return  # sums shrink along the list
            s = lengths[i]
            for copies in range(min(left // s, counts[s]), 0, -1):
                work.steps += 1
                if sums[i + 1] >> (left - copies * s) & 1:
                    yield from fill(i + 1, left - copies * s, (*held, (s, copies)))

    for target in range(room, max(0, room - max_waste) - 1, -1):
        work.steps += 1
        if work.steps >= work.most:
            return
        if not sums[0] >> target & 1:
            continue
        waste = room - target
        for filling in fill(0, target, ()):
            used = dict(filling)
            if any(s <= waste and counts[s] > used.get(s, 0) for s in reversed(lengths)):
                continue  # a piece would still fit
            pieces = _spelled(filling)
            tests = Work(64 + 16 * len(pieces))
            if not any(len(other) <= len(pieces) and _fits_into(pieces, list(other), tests) for other in kept):
                kept.append(pieces)
                yield filling
            work.steps += tests.steps


def fillings(counts: dict[int, int], room: int, max_waste: int, width: int) -> list[Filling]:
    """The first ``width`` undominated fillings of the room."""
    return list(islice(list_fillings(counts, room, max_waste, Work(1 << 62)), width))


@dataclass
class Packing:
    """fillings: (sequences, content) entries; minimal: whether no packing with fewer sequences exists."""

    fillings: list[tuple[int, Filling]]
    minimal: bool
    bound: int
    nodes: int = 0
    steps: int = 0

    @property
    def sequences(self) -> int:
        return sum(many for many, _ in self.fillings)


@dataclass
class _Branch:
    counts: dict[int, int]
    before: _Branch | None  # the branch this one came from, and what was taken there
    taken: tuple[int, Filling] | None
    waste: int
    choices: Iterator[tuple[int, Filling]] = field(default_factory=lambda: iter(()))

    def path(self) -> list[tuple[int, Filling]]:
        found, at = [], self
        while at.taken:
            found.append(at.taken)
            at = at.before
        return found


def complete_bins(counts: dict[int, int], capacity: int, max_steps: int = 4_000_000, width: int = 200) -> Packing:
    """Branch and bound over the histogram of lengths; ``max_steps`` bounds its work, ``width`` the fillings of a branch."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    total, bound = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    work, completing, cut = Work(max_steps), Work(0), False
    found = best_fit(counts, capacity)
    fewest = sum(m for m, _ in found)

    def offer(taken: list[tuple[int, Filling]]) -> None:
        nonlocal found, fewest
        if (many := sum(m for m, _ in taken)) < fewest:
            found, fewest = taken, many

    def allowed() -> int:
        """The waste of any better packing."""
        return (fewest - 1) * capacity - total

    def choices(branch: _Branch) -> Iterator[tuple[int, Filling]]:
        """(sequences, filling): every filling as often as it goes, and after these every one once."""
        nonlocal cut
        largest = max(branch.counts)
        rest = dict(branch.counts)
        rest[largest] -= 1
        again: list[Filling] = []
        listed = list_fillings(rest, capacity - largest, allowed() - branch.waste, work)
        for number, filling in enumerate(listed):
            if number == width:
                cut = True
                break
            need = dict(filling)
            need[largest] = need.get(largest, 0) + 1
            most = min(branch.counts[s] // c for s, c in need.items())
            whole = tuple(sorted(need.items(), reverse=True))
            yield most, whole
            if most > 1:
                again.append(whole)
        for whole in again:
            yield 1, whole

    def opened(branch: _Branch) -> bool:
        """Prepare the choices of a branch; false if it is complete or cannot beat the best packing."""
        if branch.waste > allowed():
            return False
        if not branch.counts:
            offer(branch.path())
            return False
        if completing.steps <= work.steps:
            offer(branch.path() + best_fit(branch.counts, capacity, completing))
        branch.choices = choices(branch)
        return True

    nodes, root = 0, _Branch(counts, None, None, 0)
    stack = [root] if fewest > bound and opened(root) else []
    while stack and fewest > bound and work.steps < max_steps:
        choice = next(stack[-1].choices, None)
        if choice is None:
            stack.pop()
            continue
        nodes += 1
        (many, filling), above = choice, stack[-1]
        left = dict(above.counts)
        for s, c in filling:
            left[s] -= many * c
        work.steps += len(left)
        child = _Branch({s: n for s, n in left.items() if n}, above, choice,
                        above.waste + many * (capacity - sum(s * c for s, c in filling)))
        if opened(child):
            stack.append(child)
    ran_out = not stack and not cut and work.steps < max_steps
    return Packing(found, fewest == bound or ran_out, bound, nodes, work.steps)


def token_pieces(docs: DataFrame, capacity: int = 2048, separator: int = 0, tokenizer: str = "word_bpe_49k.json",
                 keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document: its ids, then the separator.

    Only longer documents are cut. keep_ids adds the ids themselves (binary, 4 bytes each, little-endian).
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), whole_text(docs, text).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    end = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer)
        for batch in batches:
            source, pieces = [], []
            for i, text_value in enumerate(batch.column(1)):
                ids = text_ids(text_value.as_py(), table) + end
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    source.append(i)
                    pieces.append((number, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            number, start, length, crc, ids = zip(*pieces, strict=True) if pieces else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(number, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = rows.mapInArrow(cut, schema)
    return pieces if keep_ids else pieces.drop("ids")


def _slots(packing: Packing) -> dict[str, np.ndarray]:
    """For each length and rank within it the place: entries sorted by (length, first rank)."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for many, filling in packing.fillings:
        offset = 0
        for length, copies in filling:
            first = rank.get(length, 0)
            rank[length] = first + many * copies
            rows.append((length, first, base, copies, offset))
            offset += length * copies
        base += many
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "copies", "offset"), columns, strict=True))


def ranked_by_length(pieces: DataFrame, rows_per_part: int = 4096) -> tuple[DataFrame, dict[int, int]]:
    """Number equal lengths from 0 without gaining a task that holds all pieces of one length.

    The pieces are written once with a salt; counts per (length, salt) give each part the rank it starts at.
    """
    written = cut_lineage(pieces.withColumn("part", F.monotonically_increasing_id()))
    parts = max(64, math.ceil(written.count() / rows_per_part))
    # Ids run on within a task; the hash spreads them evenly whatever the number of tasks.
    written = written.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)))
    counts = cut_lineage(written.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from_rank"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (written.withColumn("rank", F.row_number().over(within) - 1)
              .join(starts, ["length", "part"])
              .withColumn("rank", F.col("rank") + F.col("from_rank")).drop("part", "from_rank"))
    return ranked, histogram


def pack(pieces: DataFrame, capacity: int = 2048, max_steps: int = 4_000_000) -> tuple[DataFrame, Packing]:
    """Pieces (doc_id, piece, start, length, ids_crc32 and more) with sequence_id and offset, and the packing.

    What comes to the driver is the histogram: at most ``capacity`` rows, whatever the size of the corpus.
    """
    ranked, histogram = ranked_by_length(pieces)
    packing = complete_bins(histogram, capacity, max_steps)
    slots = _slots(packing)
    longest = int(max(histogram.values(), default=0)) + 1

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sizes, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        keys = slots["length"] * longest + slots["first"]
        at = np.searchsorted(keys, sizes * longest + ranks, side="right") - 1
        inside = ranks - slots["first"][at]
        copies = slots["copies"][at]
        return pa.StructArray.from_arrays(
            [pa.array(slots["base"][at] + inside // copies),
             pa.array(slots["offset"][at] + inside % copies * sizes)], ["sequence_id", "offset"])

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(*[c for c in ranked.columns if c != "rank"], "place.sequence_id", "place.offset"), packing


def pack_documents(docs: DataFrame, capacity: int = 2048, separator: int = 0, tokenizer: str = "word_bpe_49k.json",
                   keep_ids: bool = False, max_steps: int = 4_000_000) -> DataFrame:
    """One row per piece with its place."""
    return pack(token_pieces(docs, capacity, separator, tokenizer, keep_ids), capacity, max_steps)[0]


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: sequence_id, n_tokens, ids (binary)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens in a group
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
