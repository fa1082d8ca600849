"""Content-defined phrases of a corpus, and where equal ones stand first.

A text is a row of symbols (bytes or words). A window is L symbols in a row. Every window has a trigger: of the k-symbol
grams inside it, the first one with the smallest rolling hash. Neighbouring windows mostly share their trigger, and all
windows with the same trigger, at the same place, form a phrase: the symbols from its first window's start to its last one's
end. The trigger depends on nothing but the window, so equal windows have equal triggers at equal distances, wherever they stand.
About every (L-k)/2-th symbol begins a phrase.

told() compares phrases instead of windows:
1. Triggers are counted over the corpus (combined per block and per task). Those that occur once are done: their windows
   occur once.
2. Phrases with other triggers meet by trigger. A phrase that is equal to an earlier one repeats all its windows. Phrases are
   equal if two hashes of 64 bits agree, that of the trigger and that of the phrase.
3. Where a trigger has several different phrases (at the borders of repeated passages), the first of each kind is given out to be
   compared by what it holds: byte_dedup and word_dedup do that in their own ways.

The sets of triggers and of those first phrases reach the tasks as bit maps, sized by their number up to 2^MOST_BITS bits; false
hits in them only mean more rows in steps that are exact. With more triggers than that the map lets more phrases pass, all of
them at worst; with more first phrases than MAPPED they are joined with the documents instead. Triggers with over a `HOT`-th of all
phrases are settled by an aggregate that is combined per task; of their phrases the common ones, at most 1/`HOT_KIND`, are
broadcast, so none meets in one task. Triggers with over WIDE phrases to compare are dealt out by phrase, and compared by an
aggregate of window hashes; word_dedup cuts their phrases into runs first, which meet by what their windows have in common (see
cores()), so that windows come out one by one only where over WIDE runs agree in that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE, INVERSE, mix, powers, running
from .shared import saved

#: Bits of a map: 16 for each hash, within these bounds (64 MB at most).
LEAST_BITS, MOST_BITS = 16, 29
MAPPED = 1 << 26
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of x[i:i+w] for each i that has w values."""
    n, out = 1, x
    while 2 * n <= w:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - n : w - n + len(x) - w + 1]) if n < w else out


def phrases(symbols: np.ndarray, cuts: np.ndarray, L: int, k: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end in symbols (uint64 hashes, fewer than 2^24; text i is cuts[i]:cuts[i+1]).

    For each phrase: text, start of its first window in the text, number of windows, trigger hash, phrase hash, and the
    trigger's place from the start.
    """
    sums = running(symbols)
    inverse = powers(INVERSE, len(sums))
    n = len(symbols) - L + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])
    at = np.arange(len(grams), dtype=np.uint64)
    trigger = (sliding_min((grams & ~_LOW) | at, L - k + 1) & _LOW).astype(np.int64)
    # windows that cross a text's end belong to none
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[:n]
    valid = np.arange(n) + L <= cuts[1:][text]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (trigger[1:] != trigger[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    keep = valid[first]
    first, count = first[keep], count[keep]
    a = trigger[first]
    whole = (sums[first + count - 1 + L] - sums[first]) * inverse[first]
    whole = mix(mix(whole ^ (count.astype(np.uint64) << np.uint64(32))) + (a - first).astype(np.uint64))
    return text[first], first - cuts[text[first]], count, grams[a], whole, a - first


#: Gives for an Arrow batch of keyed documents blocks of (first and last + 1 row, each text's place in its document, raw symbols, cuts).
Symbols = Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]

#: A trigger is hot if it has more than this part of all phrases, and so is one of its phrases.
HOT, HOT_KIND, LEAST_HOT = 1 / 2000, 1 / 20_000, 1000
#: Phrases to compare from which a hot trigger is wide.
WIDE = 1000


def hashed(raw: np.ndarray) -> np.ndarray:
    """Symbols as 64-bit values: words are hashes already."""
    return BYTE[raw] if raw.dtype == np.uint8 else raw


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


def bit_map(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of 2^bits bits with one set for each hash."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = hashes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in rows.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)[: len(out)]
    return out


def in_map(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(found) - 1)
    return (found[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def place_of(phrase: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of one phrase at one place."""
    return mix(phrase ^ mix((doc.astype(np.uint64) ^ mix(sub.astype(np.uint64))) * np.uint64(INVERSE) + start.astype(np.uint64)))


def batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def triggers(docs: DataFrame, symbols: Symbols, L: int, k: int) -> DataFrame:
    """trigger, n: its occurrences, combined over each block."""

    def count(batches):
        for b in batches:
            for _, _, _, raw, cuts in symbols(b):
                hashes, n = np.unique(phrases(hashed(raw), cuts, L, k)[3], return_counts=True)
                yield batch(trigger=hashes, n=n.astype(np.int32))

    return docs.select("id", "sub", "text").mapInArrow(count, "trigger long, n int")


PHRASE = "trigger long, phrase long, id long, sub long, start long, n int"


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("id").to_numpy(), b.column("sub").to_numpy()


def occurrences(docs: DataFrame, symbols: Symbols, L: int, k: int, wanted, hot: np.ndarray, of_hot: bool) -> DataFrame:
    """Every phrase whose trigger is in the broadcast map, of hot triggers or of the others."""

    def find(batches):
        for b in batches:
            ids, subs = _ids(b)
            for i, _, place, raw, cuts in symbols(b):
                text, start, n, trigger, whole, _ = phrases(hashed(raw), cuts, L, k)
                m = in_map(wanted.value, trigger)
                if len(hot) or of_hot:
                    m &= np.isin(trigger, hot) == of_hot
                row = text[m] + i
                yield batch(trigger=trigger[m], phrase=whole[m], id=ids[row], sub=subs[row], start=start[m] + place[text[m]], n=n[m].astype(np.int32))

    return docs.select("id", "sub", "text").mapInArrow(find, PHRASE)


#: later: an earlier phrase is equal, its place is in src_id, src_sub and src_start; else others share the trigger. place: place_of() it.
TOLD = "id long, sub long, start long, n int, later boolean, place long, src_id long, src_sub long, src_start long"


def later(across: bool, first: tuple, own: tuple):
    """Whether a place (id, sub, start) comes after the first of its like: in a document with a larger id, or else later in the corpus."""
    (i, s, p), (fi, fs, fp) = own, first
    return i > fi if across else (i > fi) | ((i == fi) & ((s > fs) | ((s == fs) & (p > fp))))


def _tell(across: bool):
    """For PHRASE rows sorted by all columns: which phrases repeat an earlier one, and which others have a rival of the same trigger."""

    def tell(batches):
        carry = None
        for b in (*(b for b in batches if b.num_rows), None):
            if b is None:
                if carry is None:
                    return
                t, p, d, u, s, n = carry
                last = np.zeros(len(t), bool)
            else:
                t, p, d, u, s, n = (b.column(c).to_numpy() for c in ("trigger", "phrase", "id", "sub", "start", "n"))
                if carry is not None:
                    t, p, d, u, s, n = (np.concatenate(x) for x in zip(carry, (t, p, d, u, s, n), strict=True))
                last = t == t[-1]
            new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = later(across, (d[first], u[first], s[first]), (d, u, s))
            group = np.cumsum(np.append(True, t[1:] != t[:-1])) - 1
            rival = (np.bincount(group, weights=new) > 1)[group]
            out = late | (rival & ~last)
            f = first[out]
            yield batch(id=d[out], sub=u[out], start=s[out], n=n[out], later=late[out], place=place_of(p[out].view(np.uint64), d[out], u[out], s[out]), src_id=d[f], src_sub=u[f], src_start=s[f])
            if b is not None:
                keep = last & ~late
                carry = t[keep], p[keep], d[keep], u[keep], s[keep], n[keep]

    return tell


def told(docs: DataFrame, symbols: Symbols, L: int, k: int, across: bool, *columns: str) -> tuple[DataFrame, np.ndarray]:
    """TOLD, or columns of it: every phrase that repeats an earlier one, and the first ones of each kind where a trigger has several; and
    the wide triggers, of which there are 1 / HOT at most.

    docs: keyed. across: earlier means in a document with a smaller id; else also earlier in the same document.
    """
    sc = docs.sparkSession.sparkContext
    columns = columns or tuple(c.split()[0] for c in TOLD.split(", "))
    often = saved(triggers(docs, symbols, L, k).groupBy("trigger").agg(F.sum("n").alias("n")).where("n > 1"), "triggers")
    different, total = often.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = np.array([r.trigger for r in often.where(F.col("n") > max(LEAST_HOT, HOT * total)).select("trigger").collect()], np.int64).view(np.uint64)
    wanted = sc.broadcast(bit_map(often, "trigger", bits_for(different)))
    found = occurrences(docs, symbols, L, k, wanted, hot, False).repartition("trigger").sortWithinPartitions("trigger", "phrase", "id", "sub", "start")
    out = found.mapInArrow(_tell(across), TOLD).select(*columns)
    if not len(hot):
        return saved(out, "phrases"), hot
    found = saved(occurrences(docs, symbols, L, k, wanted, hot, True), "hot")
    # of a phrase, the rows that stay to be compared: its first one, or all in its first document
    by_doc = found.groupBy("trigger", "phrase", "id").agg(F.min(F.struct("sub", "start")).alias("at"), F.count("*").alias("n"))
    kinds = by_doc.groupBy("trigger", "phrase").agg(F.min(F.struct("id", "at.sub", "at.start")).alias("first"), F.sum("n").alias("rows"), (F.min_by("n", "id") if across else F.lit(1)).alias("stay"))
    kinds = saved(kinds, "kinds")
    rivals = saved(kinds.groupBy("trigger").agg(F.count("*").alias("kinds"), F.sum("stay").alias("stay")), "rivals")
    wide = np.array([r.trigger for r in rivals.where(F.col("kinds") > 1).where(F.col("stay") > WIDE).select("trigger").collect()], np.int64)
    rivals = rivals.drop("stay")
    kinds = kinds.join(F.broadcast(rivals), "trigger")  # a row for each hot trigger
    common = F.col("rows") > max(LEAST_HOT // 10, HOT_KIND * total)  # of so many there are 1 / HOT_KIND at most
    seldom = found.join(F.broadcast(kinds.where(common).select("trigger", "phrase")), ["trigger", "phrase"], "left_anti").join(kinds.where(~common), ["trigger", "phrase"])
    rows = found.join(F.broadcast(kinds.where(common)), ["trigger", "phrase"]).unionByName(seldom)
    late = later(across, tuple(F.col(f"first.{c}") for c in ("id", "sub", "start")), (F.col("id"), F.col("sub"), F.col("start")))
    rows = rows.withColumn("later", late).where("later or kinds > 1")

    def places(batches):
        for b in batches:
            p, d, u, s = (b.column(c).to_numpy() for c in ("phrase", "id", "sub", "start"))
            own = {c: b.column(c) for c in ("id", "sub", "start", "n", "later")}
            yield batch(**own, place=place_of(p.view(np.uint64), d, u, s), **{c: b.column(c) for c in ("src_id", "src_sub", "src_start")})

    rows = rows.select("phrase", "id", "sub", "start", "n", "later", *[F.col(f"first.{c}").alias(f"src_{c}") for c in ("id", "sub", "start")])
    return saved(out.unionByName(rows.mapInArrow(places, TOLD).select(*columns)), "phrases"), wide


BORDER = "trigger long, salt long, id long, sub long, start long, ahead long, raw binary"


def cores(raw: np.ndarray, trigger: np.ndarray, at: np.ndarray, ahead: np.ndarray, n: np.ndarray, L: int, step: int) -> tuple[np.ndarray, ...]:
    """Phrases, cut where the trigger's place in the window passes a multiple of step, and what the windows of each run have in common.

    at: where the trigger is in raw; ahead: its place from the phrase's start; n: windows. For each run: number of its phrase, its first
    window's number in it, its windows, and a hash of the trigger and of the L - step + 1 symbols that all windows with the trigger
    at such a place hold. Equal windows are in runs that agree in that.
    """
    high, low = ahead // step, (ahead - n + 1) // step
    count = high - low + 1
    phrase = np.repeat(np.arange(len(n)), count)
    part = high[phrase] - (np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count))
    most = np.minimum(ahead[phrase], part * step + step - 1)
    least = np.maximum((ahead - n + 1)[phrase], part * step)
    sums = running(hashed(raw))
    first = at[phrase] - part * step
    core = (sums[first + L - step + 1] - sums[first]) * powers(INVERSE, len(sums))[first]
    return phrase, ahead[phrase] - most, most - least + 1, mix(trigger[phrase] ^ mix(mix(core) + part.astype(np.uint64)))


def bordering(docs: DataFrame, symbols: Symbols, L: int, k: int, rivals: DataFrame, wide: np.ndarray, step: int | None = None) -> DataFrame:
    """BORDER, dealt out by trigger and sorted: the phrases whose place is among those of rivals (id, sub, place), with their symbols.

    ahead: where the trigger is. salt: 0, but for wide triggers a hash of the place, which spreads them. With a step, phrases of
    wide triggers are cut into runs first, which have the hash that cores() gives for a trigger; only those that are wide by it have a salt then.
    """
    n = rivals.count()
    if n <= MAPPED:
        wanted = docs.sparkSession.sparkContext.broadcast(bit_map(rivals, "place", bits_for(n)))
        docs = docs.select("id", "sub", "text")
    else:
        wanted = None
        docs = docs.join(rivals.groupBy("id", "sub").agg(F.collect_set("place").alias("places")), ["id", "sub"]).select("id", "sub", "text", "places")

    def find(batches):
        for b in batches:
            ids, subs = _ids(b)
            own = None if wanted else b.column("places").flatten().to_numpy().view(np.uint64)
            for i, _, place, raw, cuts in symbols(b):
                text, start, n, trigger, whole, ahead = phrases(hashed(raw), cuts, L, k)
                row, at = text + i, start + place[text]
                places = place_of(whole, ids[row], subs[row], at)
                m = np.flatnonzero(in_map(wanted.value, places) if wanted else np.isin(places, own))
                first, size, n, trigger, ahead, at, row, places = (start + cuts[text])[m], n[m] + L - 1, n[m], trigger[m], ahead[m], at[m], row[m], places[m]
                apart = np.isin(trigger.view(np.int64), wide)
                salt = np.where(apart, (places >> np.uint64(54)) + np.uint64(1), 0).astype(np.int64)
                if step and apart.any():
                    cut, more, windows, core = cores(raw, trigger[apart], (first + ahead)[apart], ahead[apart], n[apart], L, step)
                    both = lambda x, add=0, own=apart, cut=cut: np.concatenate([x[~own], x[own][cut] + add])
                    first, at, ahead, row, salt = both(first, more), both(at, more), both(ahead, -more), both(row), both(salt)
                    size, trigger = np.concatenate([size[~apart], windows + L - 1]), np.concatenate([trigger[~apart], core])
                parts = [raw[x : x + z].tobytes() for x, z in zip(first.tolist(), size.tolist(), strict=True)]
                yield batch(trigger=trigger, salt=salt, id=ids[row], sub=subs[row], start=at, ahead=ahead, raw=pa.array(parts, pa.binary()))

    rows = docs.mapInArrow(find, BORDER)
    if step and len(wide):
        rows = saved(rows, "border")
        often = saved(rows.where("salt > 0").groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > WIDE), "cores")
        common = docs.sparkSession.sparkContext.broadcast(bit_map(often, "trigger", bits_for(often.count())))

        def salted(batches):
            for b in batches:
                salt = np.where(in_map(common.value, b.column("trigger").to_numpy().view(np.uint64)), b.column("salt").to_numpy(), 0)
                yield batch(**{c: pa.array(salt) if c == "salt" else b.column(c) for c in b.schema.names})

        rows = rows.mapInArrow(salted, BORDER)
    return rows.repartition("trigger", "salt").sortWithinPartitions("trigger")


#: Phrases of one trigger that a task holds.
GROUP = 20_000


def by_trigger(batches, settle, whole, group: int, step: int = 2000):
    """For batches of BORDER rows sorted by trigger: settle(rows) of whole triggers' phrases. Of a trigger with salts, or one with more than `group`,
    which can't be held, whole(rows) part by part. rows: trigger, id, sub, start, ahead as arrays and raw as a list."""
    names = ("trigger", "id", "sub", "start", "ahead")
    held: list[tuple] = []
    flushed = None  # a trigger that is too large

    def joined():
        return [np.concatenate([h[i] for h in held]) for i in range(len(names))] + [[r for h in held for r in h[-1]]]

    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            apart = part.column("salt").to_numpy() > 0
            if apart.any():
                large = part.filter(pa.array(apart))
                yield whole([*(large.column(c).to_numpy() for c in names), large.column("raw").to_pylist()])
                part = part.filter(pa.array(~apart))
            if not part.num_rows:
                continue
            held.append((*(part.column(c).to_numpy() for c in names), part.column("raw").to_pylist()))
            rows = joined()
            if flushed is not None:
                large = int((rows[0] == flushed).sum())
                if large:
                    yield whole([x[:large] for x in rows])
                    rows = [x[large:] for x in rows]
            done = int((rows[0] != rows[0][-1]).sum()) if len(rows[0]) else 0
            if done:
                yield settle([x[:done] for x in rows])
            rest = [x[done:] for x in rows]
            held = [tuple(rest)] if len(rest[0]) else []
            if len(rest[0]) > group:
                yield whole(rest)
                flushed, held = rest[0][0], []
    if held:
        rows = joined()
        yield whole(rows) if flushed is not None and rows[0][0] == flushed else settle(rows)


def windows(rows, L: int, kind) -> tuple[np.ndarray, ...]:
    """For BORDER rows as by_trigger() gives them: each window's row, number in its phrase, and hash (with the trigger's place in it)."""
    ahead, raw = rows[4], rows[5]
    values = [np.frombuffer(r, kind) for r in raw]
    size = np.array([len(v) for v in values])
    n = size - L + 1
    sums = running(hashed(np.concatenate(values)))
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(size) - size)[row] + step
    own = mix((sums[first + L] - sums[first]) * powers(INVERSE, len(sums))[first]) + (ahead[row] - step).astype(np.uint64)
    return row, step, mix(own)


def covered(n: int, starts, stops) -> np.ndarray:
    """For n symbols, which of them some run covers."""
    change = np.zeros(n + 1, np.int32)
    if starts is not None and len(starts):
        np.add.at(change, np.asarray(starts), 1)
        np.add.at(change, np.asarray(stops), -1)
    return np.cumsum(change[:n]) > 0
