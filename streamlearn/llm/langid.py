"""Language of mixed texts: scripts narrow the candidates, a Viterbi path over words labels spans.

A word is a letter and the letters and combining marks after it. The script of its first letter picks the candidate languages (those that had at least
`script_share` of their training letters in it; all, if none had). Each candidate scores the word by the log
probabilities of its character trigrams (with a border at both ends), hashed into a fixed number of cells. A switch
of language costs `penalty` nats; the best path over the whole document labels every word, and runs of words with one
label are the spans. The document's language is the one with most letters on the path, and its score their share.

Most documents are in one language. That the path which never switches is the best one is proved without a Viterbi
run where no other language gains more than `penalty` on any stretch (the largest subarray of score differences, by
running minima): an excursion of m segments pays at least m penalties. Other documents get the full recursion.

The model is trained here from text and non-null lang of rows with crc32(doc_id) mod 4 not 2, on about
`train_docs` of them (a documented bound, chosen by hash; whole texts); the counts are summed on the executors, and
its size depends on the number of languages only.

Defined results: und with score 0 for a null text, a text without a letter, or without a training row. held_out is
false for a null doc_id, which never trains. Ties go to the language that sorts first. Repeated rows are labelled row by row; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sampled

CELLS = 1 << 15
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Last code point of a stretch and its script; fixed values of the Unicode blocks.
SCRIPT_RANGES = (
    (0x24F, "latin"), (0x2FF, "latin"), (0x36F, "mark"), (0x3FF, "greek"), (0x52F, "cyrillic"), (0x58F, "armenian"),
    (0x5FF, "hebrew"), (0x6FF, "arabic"), (0x74F, "syriac"), (0x77F, "arabic"), (0x8FF, "other"), (0x97F, "devanagari"),
    (0x9FF, "bengali"), (0xA7F, "gurmukhi"), (0xAFF, "gujarati"), (0xB7F, "oriya"), (0xBFF, "tamil"), (0xC7F, "telugu"),
    (0xCFF, "kannada"), (0xD7F, "malayalam"), (0xDFF, "sinhala"), (0xE7F, "thai"), (0xEFF, "lao"), (0xFFF, "tibetan"),
    (0x109F, "myanmar"), (0x10FF, "georgian"), (0x11FF, "hangul"), (0x137F, "ethiopic"), (0x1DFF, "other"), (0x1EFF, "latin"),
    (0x1FFF, "greek"), (0x303F, "other"), (0x309F, "kana"), (0x30FF, "kana"), (0x318F, "hangul"), (0x33FF, "other"),
    (0x9FFF, "han"), (0xABFF, "other"), (0xD7FF, "hangul"), (0xFAFF, "han"), (0x1FFFF, "other"), (0x3FFFF, "han"), (0x10FFFF, "other"),
)


def script(char: str) -> str:
    from bisect import bisect_left

    return SCRIPT_RANGES[bisect_left(SCRIPT_RANGES, (ord(char), ""))][1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def cells(words: list[str]):
    """Cells of the trigrams of all words, and where each word's begin."""
    import numpy as np

    data = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    first = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    h = (data[first] * np.uint64(0x9E3779B97F4A7C15) + data[first + 1]) * np.uint64(0xBF58476D1CE4E5B9) + data[first + 2] * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(CELLS)).astype("i8"), np.concatenate([[0], np.cumsum(size)[:-1]])


class Model:
    def __init__(self, languages: list[str], log_p, scripts: dict[str, list[int]], penalty: float):
        self.languages, self.log_p, self.scripts, self.penalty = languages, log_p, scripts, penalty

    @staticmethod
    def of_counts(counts: dict[str, dict[int, int]], letters: dict[str, dict[str, int]], *, penalty: float, script_share: float) -> Model:
        import numpy as np

        languages = sorted(counts)
        table = np.zeros((CELLS, len(languages)))
        scripts: dict[str, list[int]] = defaultdict(list)
        for k, lang in enumerate(languages):
            for c, n in counts[lang].items():
                table[c, k] = n
            total = sum(letters[lang].values())
            for s, n in letters[lang].items():
                if n >= script_share * total:
                    scripts[s].append(k)
        log_p = np.log((table + 0.3) / (table.sum(axis=0) + 0.3 * CELLS))
        return Model(languages, log_p, dict(scripts), penalty)


class Labeller:
    """Labels texts; keeps the scores of words it has seen, within a bound."""

    def __init__(self, model: Model, keep: int = 200_000):
        import numpy as np

        self.m, self.keep = model, keep
        self.memo: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        import numpy as np

        if len(self.memo) + len(words) > self.keep:
            self.memo.clear()
            self.scores = self.scores[:0]
        new = sorted(words)
        at, begin = cells(new)
        s = np.add.reduceat(self.m.log_p[at], begin, axis=0)
        every = range(len(self.m.languages))
        for i, w in enumerate(new):
            allowed = self.m.scripts.get(script(w[0]), every)
            if len(allowed) < len(every):
                s[i, [k for k in every if k not in allowed]] -= 50.0 * len(w)
            self.memo[w] = len(self.scores) + i
        self.scores = np.concatenate([self.scores, s])

    def texts(self, texts: list[str]):
        """(language or None, score, labels of the words, words) of each text; labels is one number if all are equal."""
        import numpy as np

        if not self.m.languages:
            yield from ((None, 0.0, None, []) for _ in texts)
            return
        lists = [_WORD.findall(t.lower()) for t in texts]
        unseen = {w for ws in lists for w in ws if w not in self.memo}
        if unseen:
            if len(self.memo) + len(unseen) > self.keep:
                unseen = {w for ws in lists for w in ws}
            self._learn(unseen)
        for words in lists:
            if not words:
                yield None, 0.0, None, words
                continue
            s = self.scores[np.array([self.memo[w] for w in words])]
            labels = self.path(s)
            if isinstance(labels, int):
                best, share = labels, 1.0
            else:
                letters = np.bincount(labels, [len(w) for w in words], len(self.m.languages))
                best = int(letters.argmax())
                share = float(letters[best] / letters.sum())
            # how sure the words are: the mean margin to the next best language, squashed
            total = s.sum(axis=0)
            rest = np.delete(total, best)
            margin = (total[best] - rest.max()) / len(words) if len(rest) else 1.0
            yield self.m.languages[best], share / (1.0 + float(np.exp(-4.0 * min(max(margin, -50.0), 50.0)))), labels, words

    def path(self, s):
        """The best path's labels, or one number if it never switches. s: words x languages."""
        import numpy as np

        total = s.sum(axis=0)
        best = int(total.argmax())
        gain = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s - s[:, best : best + 1], axis=0)])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= self.m.penalty / 2:  # m segments gain m / 2 penalties at most and pay m - 1
            return best
        return viterbi(s, self.m.penalty)


def viterbi(s, penalty: float):
    import numpy as np

    n, m = s.shape
    v = s[0].tolist()
    came = []
    for row in s[1:].tolist():
        top = max(range(m), key=v.__getitem__)
        jump = v[top] - penalty
        step = [k if v[k] >= jump else top for k in range(m)]
        v = [max(v[k], jump) + row[k] for k in range(m)]
        came.append(step)
    at = max(range(m), key=v.__getitem__)
    out = np.empty(n, "i8")
    out[-1] = at
    for i in range(n - 2, -1, -1):
        at = came[i][at]
        out[i] = at
    return out


def train(docs: DataFrame, *, doc_id: str, text: str, lang: str, train_docs: int, penalty: float, script_share: float) -> Model:
    usable = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    some = sampled(usable, train_docs, "i").select("l", "t")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows: dict[str, object] = {}
            letters: dict[tuple[str, str], int] = defaultdict(int)
            for lang, t in zip(batch.column(0), batch.column(1)):
                words = _WORD.findall(t.as_py().lower())
                if not words:
                    continue
                key = lang.as_py()
                at, _ = cells(words)
                rows[key] = rows.get(key, 0) + np.bincount(at, minlength=CELLS)
                for w in words:
                    letters[key, script(w[0])] += len(w)
            out = [(k, "", int(c), int(v[c])) for k, v in rows.items() for c in np.flatnonzero(v)]
            out += [(k, s, -1, n) for (k, s), n in letters.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "script", "cell", "n"])

    sums = map_arrow(some, count, "lang string, script string, cell int, n bigint").groupBy("lang", "script", "cell").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    letters: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sums.collect():  # languages x cells at most
        if r.cell >= 0:
            counts[r.lang][r.cell] = r.n
        else:
            letters[r.lang][r.script] = r.n
    return Model.of_counts(counts, letters, penalty=penalty, script_share=script_share)


def spans_of(text: str, labels, words: list[str], languages: list[str]) -> str:
    """lang:start:end of the runs of words with one label; code points, end exclusive."""
    where = [m.span() for m in _WORD.finditer(text)]
    if isinstance(labels, int) or len(where) != len(words):  # a few letters change their number in lower case
        lang = languages[labels] if isinstance(labels, int) else languages[int(labels[0])]
        return f"{lang}:{where[0][0]}:{where[-1][1]}" if where else ""
    out, begin = [], 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[begin]:
            out.append(f"{languages[int(labels[begin])]}:{where[begin][0]}:{where[i - 1][1]}")
            begin = i
    return ",".join(out)


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, spans string"


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = 4000, penalty: float = 12.0, script_share: float = 0.01) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the labelled spans of texts that mix languages (null: one language)."""
    fitted = train(docs, doc_id=doc_id, text=text, lang=lang, train_docs=train_docs, penalty=penalty, script_share=script_share)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        import pyarrow as pa

        own = Labeller(model.value)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                stop, n = start, 0
                while stop < batch.num_rows and n < 1_000_000:
                    n += len(batch.column(2)[stop].as_py())
                    stop += 1
                part = batch.slice(start, stop - start)
                texts = part.column(2).to_pylist()
                out = []
                for t, (lang, score, labels, words) in zip(texts, own.texts(texts)):
                    mixed = labels is not None and not isinstance(labels, int)
                    out.append((lang or "und", score, spans_of(t, labels, words, own.m.languages) if mixed else None))
                columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "spans"])
                start = stop

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(own, run, SCHEMA)
