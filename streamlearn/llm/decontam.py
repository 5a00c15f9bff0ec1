"""Benchmark decontamination by template windows with slot consistency.

Method: texts and benchmark items are canonicalised: numbers, names (capitalised words) and units become typed
placeholders, other words lose their case. Windows of eight tokens are hashed and joined with the hash table of the
benchmark's windows, in two views of a text:

* word by word: a capitalised word inside a sentence is a name; windows are joined as templates and as they are;
* folded: a capitalised word is a name also where a sentence begins, and several in a row are one name, so that "Tom
  bought" and "Anna Lee bought" agree; windows are joined as templates.

Windows on one diagonal (same offset between document and item) form a match; its slots pair the item's values with
the document's. Two values may become one and one may become two, but where both meet in a pair, the windows that hold
its values are dropped, unless they are equal word for word. A document is contaminated by an item if in one view
consistent matches cover `min_cover` of its windows, or of those that may match as templates and then of its tokens
too, or hold a run of `min_run` tokens. So a question with other numbers and names is found as well, and a verbatim
copy of any item always is. An item of fewer than MIN_TOKENS tokens is found where a line or a whole text equals it
word for word.

A benchmark of at most BROADCAST_CHARS characters is broadcast, and documents never leave their tasks. Beyond that
window hashes of documents that pass a bit filter of fixed size are hash-joined with those of the items, and only the
pairs that share one meet as texts and are matched in the same way; documents are read twice, whatever the
benchmark's size. One passage that a third of the documents share is only found more often.

Defined results: null texts and texts without letters and digits have no tokens, and such items match nothing; items
shorter than a window have one window of their own length. Windows with fewer than three literal words match only
word for word. Equal items are all reported; repeated rows are reported row by row. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Coded, bit_table, map_arrow, staged

WINDOW, MIN_TOKENS, MIN_WORDS = 8, 5, 3
#: Most characters of benchmark text that are broadcast.
BROADCAST_CHARS = 4_000_000
#: Bits of the filter of window hashes (8 MB), and most contaminated rows that are broadcast to drop them.
FILTER_BITS, MAX_BROADCAST_ROWS = 1 << 26, 500_000
#: Units that stand after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar psi c f k mph kmh usd eur gbp dollars dollar euros euro cents cent pounds pound meters meter metres metre kilometers kilometres miles mile feet foot inches inch grams gram kilograms kilogram liters litres hours hour minutes minute seconds second days day weeks week months month years year percent"
_LINE, _MARK, _NUM, _NAME, _UNIT, _CAPITAL, _WORD = range(7)
SCHEMA = "doc_id bigint, text_hash bigint, item_id bigint, kind string, matched bigint, windows bigint, run_tokens bigint, slots bigint"


class View(NamedTuple):
    """Tokens of texts as arrays: kind, hash of the template, hash of the raw value; text n has bounds[n]:bounds[n + 1]."""

    kinds: Any
    templates: Any
    raws: Any
    bounds: Any


class Templates:
    """Both views of texts, and the stretches (start, tokens) of their lines in the first."""

    def __init__(self, keep: int = 150_000):
        import re

        self.find = re.compile(r"[.!?:;\n]|\d+(?:[.,]\d+)*|[^\W\d_]+|\w+").findall
        self.units = frozenset(UNITS.split())
        self.tokens = Coded(self._token, keep)

    def _token(self, t: str) -> int:
        """Hash of a token, with its kind in the last three bits."""
        import xxhash

        c, low = t[0], t.lower()
        kind = _LINE if c == "\n" else _MARK if c in ".!?:;" else _NUM if c.isdigit() else _UNIT if low in self.units else _CAPITAL if c.isupper() else _WORD
        return (xxhash.xxh64_intdigest(low) & -8) | kind

    def __call__(self, texts: list[str]) -> tuple[View, View, tuple]:
        import numpy as np

        lists = [self.find(t) for t in texts]
        size = [len(x) for x in lists]
        codes = self.tokens.of(chain.from_iterable(lists), sum(size))
        kinds, raws = (codes & np.uint64(7)).astype("i1"), codes >> np.uint64(3)
        starts = np.concatenate([[0], np.cumsum(size)]).astype("i8")
        starts = starts[:-1][starts[:-1] < len(kinds)]
        before = np.concatenate([[_MARK], kinds[:-1]]) if len(kinds) else kinds
        before[starts] = _MARK
        owner, real = np.repeat(np.arange(len(texts)), size), kinds > _MARK

        def view(kinds, raws, owner) -> View:
            templates = np.where((kinds == _NUM) | (kinds == _NAME) | (kinds == _UNIT), kinds.astype("u8"), raws)
            return View(kinds, templates, raws, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype("i8"))

        # a unit is one only after a number
        kinds = np.where((kinds == _UNIT) & (before != _NUM), _WORD, kinds)
        plain = view(np.where((kinds == _CAPITAL) & (before > _MARK), _NAME, kinds)[real], raws[real], owner[real])
        line = np.cumsum(kinds == _LINE) + owner
        at = np.flatnonzero(np.diff(line[real], prepend=-1))
        lines = at, np.diff(np.append(at, len(plain.raws)))

        kinds = np.where(kinds == _CAPITAL, _NAME, kinds)
        follows = ((kinds == _NAME) & (before == _CAPITAL))[real]
        if not follows.any():
            return plain, view(kinds[real], raws[real], owner[real]), lines
        first = np.flatnonzero(~follows)
        last = np.append(first[1:], len(follows)) - 1
        # the value of a name is its last word, so that "Now Anna" and "Anna" are one
        return plain, view(kinds[real][first], raws[real][last], owner[real][first]), lines


def windows(kinds, templates, width: int):
    """Hash of the window that begins at each token (the last width - 1 are 0), and whether it may match."""
    import numpy as np

    from .minhash import mix

    n = max(0, len(templates) - width + 1)
    out = np.full(n, width, "u8")
    literal = np.concatenate([[0], np.cumsum(kinds >= _CAPITAL)])
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + templates[i : i + n]
    return mix(out), (literal[width : width + n] - literal[:n]) >= MIN_WORDS


class Table:
    """Sorted window hashes and where the windows begin, behind a bitmap that turns most other hashes away."""

    BITS = 20

    def __init__(self, hashes, at):
        import numpy as np

        self.at = at[np.argsort(hashes[at], kind="stable")]
        self.hashes = hashes[self.at]
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self._cell(self.hashes)] = True

    def _cell(self, hashes):
        import numpy as np

        return (hashes >> np.uint64(64 - self.BITS)).astype("i8")

    def hits(self, hashes, ok=None):
        """Positions whose hash is in the table, and the stretch of the table that equals each."""
        import numpy as np

        hit = self.known[self._cell(hashes)]
        hit = np.flatnonzero(hit if ok is None else hit & ok)
        low, high = (np.searchsorted(self.hashes, hashes[hit], side) for side in ("left", "right"))
        real = low < high
        return hit[real], low[real], high[real]


class Side:
    """Items in one view, and the hash tables of their windows by width: as templates and, if `raw`, as they are."""

    def __init__(self, view: View, raw: bool):
        import numpy as np

        self.v = view
        size = np.diff(view.bounds)
        self.width = np.where(size >= WINDOW, WINDOW, size)
        self.count = np.where(size >= MIN_TOKENS, size - self.width + 1, 0)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.tables: dict[int, tuple[Table, ...]] = {}
        #: Which windows may match as templates.
        self.eligible = np.zeros(len(view.kinds), bool)
        for width in sorted({int(w) for w, c in zip(self.width, self.count) if c}):
            h, ok = windows(view.kinds, view.templates, width)
            at = np.concatenate([np.arange(view.bounds[n], view.bounds[n] + self.count[n]) for n in np.flatnonzero((self.width == width) & (self.count > 0))])
            self.eligible[at] = ok[at]
            self.tables[width] = (Table(h, at[ok[at]]), *([Table(windows(view.kinds, view.raws, width)[0], at)] if raw else []))

    def hits(self, view: View) -> Iterator[tuple[int, Any, Any, Any, Table]]:
        """For each width and table: its windows of the texts that are in the table, and where in it."""
        import numpy as np

        for width, tables in self.tables.items():
            h, ok = windows(view.kinds, view.templates, width)
            for n, table in enumerate(tables):
                hit, low, high = table.hits(windows(view.kinds, view.raws, width)[0], None) if n else table.hits(h, ok)
                inside = hit + width <= view.bounds[np.searchsorted(view.bounds, hit, "right")]
                yield width, hit[inside], low[inside], high[inside], table


class Benchmark:
    """Hash tables of the windows of items, in both views, and of items too short for windows."""

    def __init__(self, items: list[tuple[int, str]]):
        import numpy as np

        self.ids = [i for i, _ in items]
        plain, folded, _ = Templates()([t for _, t in items])
        self.sides = Side(plain, True), Side(folded, False)
        size = np.diff(plain.bounds)
        self.owner = self.sides[0].owner
        self.short: dict[int, Table] = {}
        for width in sorted({int(w) for w in size if 0 < w < MIN_TOKENS}):
            self.short[width] = Table(windows(plain.kinds, plain.raws, width)[0], plain.bounds[:-1][size == width])

    def whole(self, view: View, lines: tuple) -> Iterator[tuple[int, Any, Any, Any, Table]]:
        """Lines and whole texts that equal a short item: width, where they begin, and where in the table."""
        import numpy as np

        for width, table in self.short.items():
            at = np.concatenate([lines[0][lines[1] == width], view.bounds[:-1][np.diff(view.bounds) == width]])
            at = np.unique(at)
            hit, low, high = table.hits(windows(view.kinds, view.raws, width)[0][at])
            yield width, at[hit], low, high, table

    def hashes(self) -> Iterator[Any]:
        """Hashes of all tables, told apart by their kind."""
        for k, side in enumerate(self.sides):
            for width, tables in side.tables.items():
                yield from (tagged(t.hashes, k, width, n) for n, t in enumerate(tables))
        yield from (tagged(t.hashes, 2, width, 0) for width, t in self.short.items())


def tagged(hashes, view: int, width: int, table: int):
    import numpy as np

    from .minhash import mix

    return mix(hashes + np.uint64(1 + view + 4 * (table + 2 * width)))


def text_hashes(plain: View, folded: View, lines: tuple):
    """Tagged hashes of everything in texts that a table of any benchmark may hold, and the numbers of their texts."""
    import numpy as np

    parts, where = [], []
    for k, v in enumerate((plain, folded)):
        size = np.diff(v.bounds)
        for width in range(MIN_TOKENS, WINDOW + 1):
            if (size >= width).any():
                at = np.arange(len(v.kinds) - width + 1)
                at = at[at + width <= v.bounds[np.searchsorted(v.bounds, at, "right")]]
                h, ok = windows(v.kinds, v.templates, width)
                found = [(tagged(h[at], k, width, 0)[ok[at]], at[ok[at]])] + ([(tagged(windows(v.kinds, v.raws, width)[0][at], k, width, 1), at)] if not k else [])
                for h, a in found:
                    parts.append(h)
                    where.append(np.searchsorted(v.bounds, a, "right") - 1)
    for width in range(1, MIN_TOKENS):
        at = np.unique(np.concatenate([lines[0][lines[1] == width], plain.bounds[:-1][np.diff(plain.bounds) == width]]))
        if len(at):
            parts.append(tagged(windows(plain.kinds, plain.raws, width)[0][at], 2, width, 0))
            where.append(np.searchsorted(plain.bounds, at, "right") - 1)
    return (np.concatenate(parts), np.concatenate(where)) if parts else (np.empty(0, "u8"), np.empty(0, "i8"))


def clashes(values: dict[int, tuple[int, int, int]]) -> set[int]:
    """Slots (kind, item's value, document's value) that share a value with a pair whose both values have other partners."""
    there, back = defaultdict(set), defaultdict(set)
    for k, x, y in values.values():
        there[k, x].add(y)
        back[k, y].add(x)
    bad = [v for v in set(values.values()) if len(there[v[0], v[1]]) > 1 and len(back[v[0], v[2]]) > 1]
    left, right = {(k, x) for k, x, _ in bad}, {(k, y) for k, _, y in bad}
    return {j for j, (k, x, y) in values.items() if (k, x) in left or (k, y) in right}


class Matcher:
    def __init__(self, bench: Benchmark, min_cover: float, min_run: int):
        self.b, self.min_cover, self.min_run = bench, min_cover, min_run
        self.templates = Templates()

    def __call__(self, texts: list[str]) -> Iterator[tuple]:
        """(text number, item number, kind, matched windows, windows, longest run in tokens, slots) of what is contaminated."""
        import numpy as np

        plain, folded, lines = self.templates(texts)
        out: dict[tuple[int, int], tuple] = {}
        for width, hit, low, high, table in self.b.whole(plain, lines):
            for n, x, y in zip((np.searchsorted(plain.bounds, hit, "right") - 1).tolist(), low.tolist(), high.tolist()):
                out |= {(n, int(self.b.owner[j])): ("exact", 1, 1, width, 0) for j in table.at[x:y].tolist()}
        for side, view in zip(self.b.sides, (plain, folded)):
            for key, match in self._matches(side, view).items():
                out.setdefault(key, match if view is plain else ("template", *match[1:]))
        yield from ((n, item, *match) for (n, item), match in sorted(out.items()))

    def _matches(self, side: Side, view: View) -> dict[tuple[int, int], tuple]:
        import numpy as np

        found: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for _, hit, low, high, table in side.hits(view):
            text = np.searchsorted(view.bounds, hit, "right") - 1
            for at, n, x, y in zip(hit.tolist(), text.tolist(), low.tolist(), high.tolist()):
                for j in table.at[x:y].tolist():
                    found[n, int(side.owner[j])][at - j].append(j)
        return {key: match for key, diagonals in found.items() if (match := self._judged(side, view, key[1], diagonals))}

    def _judged(self, side: Side, view: View, item: int, diagonals: dict[int, list[int]]) -> tuple | None:
        b, raws = side.v, view.raws
        width, first, total = int(side.width[item]), int(b.bounds[item]), int(side.count[item])
        eligible = int(side.eligible[first : first + total].sum())
        covered, copied, longest, exact, slots = set(), set(), 0, True, 0
        for offset, starts in diagonals.items():
            own = sorted(set(starts))
            same = {j for j in own if (b.raws[j : j + width] == raws[j + offset : j + offset + width]).all()}
            values = {j: (int(b.kinds[j]), int(b.raws[j]), int(raws[j + offset])) for j in {j + d for j in own for d in range(width)} if b.kinds[j] in (_NUM, _NAME, _UNIT)}
            clash = clashes(values)
            own = [j for j in own if j in same or not any(j + d in clash for d in range(width))]
            pairs = [values[j] for j in {j + d for j in own for d in range(width)} if j in values]
            covered.update(own)
            copied.update(same)
            slots += len(pairs)
            exact &= all(x == y for _, x, y in pairs)
            run = 0
            for a, c in zip([None, *own], own):
                run = run + 1 if a is not None and c == a + 1 else width
                longest = max(longest, run)
        held = len({j + d for j in covered for d in range(width)})
        enough = len(covered) >= self.min_cover * total or longest >= self.min_run
        # windows that no template can match do not count against one, but half of the tokens must be matched
        enough = enough or (int(side.eligible[sorted(covered)].sum()) >= self.min_cover * eligible > 0 and held >= self.min_cover * (total + width - 1))
        return ("exact" if exact or len(copied) == total else "template", len(covered), total, longest, slots) if covered and enough else None


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_cover: float = 0.5, min_run: int = 13) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    chars = items.agg(F.sum(F.char_length("t") + 16)).first()[0] or 0
    if chars > BROADCAST_CHARS:
        return _joined(own, items, min_cover, min_run)
    every = sorted(((r.i, r.t) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return _matches(own, spark.sparkContext.broadcast(every), min_cover, min_run)


_FIELDS = (("doc_id", "int64"), ("text_hash", "int64"), ("item_id", "int64"), ("kind", "string"), ("matched", "int64"), ("windows", "int64"), ("run_tokens", "int64"), ("slots", "int64"))


def _batch(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], getattr(pa, kind)()) for c, (_, kind) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def _pieces(batches, chars: int = 250_000) -> Iterator[tuple[list[tuple], list[str]]]:
    """(doc_id, text_hash) and texts of a few documents at a time."""
    for batch in batches:
        rows, texts, n = [], [], 0
        for i, h, t in zip(batch.column(0), batch.column(1), batch.column(2)):
            rows.append((i.as_py(), h.as_py()))
            texts.append(t.as_py())
            n += len(texts[-1])
            if n > chars:
                yield rows, texts
                rows, texts, n = [], [], 0
        if rows:
            yield rows, texts


def _matches(own: DataFrame, items, min_cover: float, min_run: int) -> DataFrame:
    def run(batches):
        match = Matcher(Benchmark(items.value), min_cover, min_run)
        for rows, texts in _pieces(batches):
            yield _batch([(*rows[n], match.b.ids[item], *rest) for n, item, *rest in match(texts)])

    return map_arrow(own, run, SCHEMA)


def _key() -> Column:
    """doc_id as a key that is never null."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)))


def _joined(own: DataFrame, items: DataFrame, min_cover: float, min_run: int) -> DataFrame:
    """The same for a benchmark of any size: a hash join of windows finds the pairs, which are matched one by one."""
    items = staged(items.withColumn("k", F.monotonically_increasing_id()), "bench-items")

    def of_items(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.unique(np.concatenate([np.empty(0, "u8"), *Benchmark([(0, t)]).hashes()]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(np.full(len(h), k))], ["h", "k"])

    table = staged(map_arrow(items.select("k", "t"), of_items, "h bigint, k bigint"), "bench-windows")
    low, high = F.pmod("h", F.lit(FILTER_BITS)), F.pmod(F.call_function("shiftright", "h", F.lit(32)), F.lit(FILTER_BITS))
    bits = own.sparkSession.sparkContext.broadcast(bit_table(table.select(F.explode(F.array(low, high)).alias("bit")), FILTER_BITS))

    def of_docs(batches):
        import numpy as np
        import pyarrow as pa

        templates, known = Templates(), bits.value.view("u8")
        held = lambda at: (known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        for rows, texts in _pieces(batches):
            h, where = text_hashes(*templates(texts))
            mask = np.uint64(FILTER_BITS - 1)
            some = (held(h & mask) & held((h >> np.uint64(32)) & mask)).astype(bool)
            got = np.unique(np.stack([h[some].view("i8"), where[some]], axis=1), axis=0) if some.any() else np.empty((0, 2), "i8")
            at = got[:, 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array([rows[n][0] for n in at], pa.int64()), pa.array([rows[n][1] for n in at], pa.int64())], ["h", "doc_id", "text_hash"])

    shared = map_arrow(own, of_docs, "h bigint, doc_id bigint, text_hash bigint").select("h", _key().alias("d"), "text_hash")
    pairs = shared.join(table, "h").select("d", "text_hash", "k").distinct()
    met = own.withColumn("d", _key()).join(pairs, ["d", "text_hash"]).select("doc_id", "text_hash", "text", "k").join(items, "k")

    def run(batches):
        matchers: OrderedDict[int, Matcher] = OrderedDict()
        for batch in batches:
            out = []
            for d, h, text, k, i, t in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if k not in matchers:
                    matchers[k] = Matcher(Benchmark([(i, t)]), min_cover, min_run)
                    if len(matchers) > 64:
                        matchers.popitem(last=False)
                out += [(d, h, i, *rest) for _, _, *rest in matchers[k]([text])]
            yield _batch(out)

    return map_arrow(met.select("doc_id", "text_hash", "text", "k", "i", "t"), run, SCHEMA)


def without_contaminated(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with the columns of docs."""
    gone = staged(found.select(F.col("doc_id").alias("__f_id"), F.col("text_hash").alias("__f_hash")).distinct(), "contaminated")
    if gone.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        gone = F.broadcast(gone)
    own = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    on = own["__text_hash"].eqNullSafe(gone["__f_hash"]) & own[doc_id].eqNullSafe(gone["__f_id"])
    return own.join(gone, on, "left_anti").drop("__text_hash")
