"""Secrets by rules, completed by character Markov models.

Base spans come from fixed rules (assign, access, hex) and always stay. Two second-order character models, one of
random strings and one of ordinary identifiers and words, score every other token of key characters by its
log-likelihood ratio; tokens above a threshold give the added spans (markov).

Both models are trained here from labelled samples: random strings are those the base rules find in at most
`train_docs` whole documents of `train_chars` characters together (documented bounds, chosen by hash) and strings drawn uniformly from the usual
alphabets; ordinary ones are made-up identifiers and the other tokens of those documents. Secrets that no rule finds
are among those tokens, so a first model of identifiers and short tokens only scores the long ones, and those beyond
its threshold that look dealt at random (letters, and many different characters) are kept out of the ordinary class.
Every second document is held out; a threshold is the least that keeps the rates of flagged identifiers and of flagged
ordinary held-out tokens at `false_rate`, but never below `least` nats.

Defined results: a null text counts as empty and has no span. Offsets are code points, ends exclusive; an assign span
is the whole match. Repeated rows are scanned row by row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, map_arrow, training_texts

KINDS = ("assign", "access", "hex")
ADDED = "markov"
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs of at least 16: shorter runs fail, and a match is always the whole run
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_CHARS = 16
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1  # and the border
#: Words that identifiers are made of: labelled samples of the ordinary class beside the corpus's own words.
IDENTIFIER_WORDS = "account action add address application array base buffer button cache callback category change channel check child class clear client close code collection color column command config configuration connection container content context control controller convert count create current data database date default delete description details device directory display document domain edit element email enable end entity error event example exception export factory field file filter find first format function get global group handler header height host http identifier image import index info init input instance integer interface internationalization item iterator key label language last layout length level library line link list load local location log login manager map match max message method min mode model module name network new next node notification number object offset open operation option order output package page parameter parent parse password path pattern payment permission position prefix previous process product profile project property protocol provider query queue read record reference register remove render report request reset resource response responsibility responsibilities result role root row save schema search security select send server service session set settings size sort source start state status stop storage string style system table target task template test text thread time timeout title token transaction transfer tree type update upload url user util utils validate value variable vector version view web width window word write".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by start, then kind."""
    out = [(2, *m.span()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m.group()) >= 18]
    if ":" in text or "=" in text:
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    return sorted(out, key=lambda x: (x[1], x[0]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def _mixed(token: str) -> bool:
    """Whether a token may be dealt at random: it holds letters and is no row of a few characters."""
    return len(set(token)) >= LEAST_CHARS // 2 - 1 and any(c.isalpha() for c in token)


def _codes():
    import numpy as np

    table = np.full(256, _SIZE - 1, "i8")
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    return table


class Model:
    """Log-likelihood ratio of each character after two others, and the threshold of a token's sum."""

    def __init__(self, ratio, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    @staticmethod
    def _steps(tokens: list[str]):
        """Codes of each character with its two predecessors, and where each token begins."""
        import numpy as np

        data = np.frombuffer("".join(f"\0\0{t}" for t in tokens).encode("ascii"), "u1")
        c = _codes()[data]
        at = np.flatnonzero(data)
        size = np.array([len(t) for t in tokens])
        return (c[at - 2] * _SIZE + c[at - 1]) * _SIZE + c[at], np.concatenate([[0], np.cumsum(size)[:-1]])

    @staticmethod
    def log_model(tokens: list[str], smooth: float = 0.5):
        """log P(character | two before), backing off to one before and none."""
        import numpy as np

        steps, _ = Model._steps(tokens)
        three = np.bincount(steps, minlength=_SIZE**3).reshape(_SIZE, _SIZE, _SIZE).astype("f8")
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + smooth) / (one + smooth).sum()
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)
        return np.log(p3)

    def scores(self, tokens: list[str]):
        import numpy as np

        if not tokens:
            return np.empty(0)
        steps, begin = self._steps(tokens)
        return np.add.reduceat(self.ratio.ravel()[steps], begin)

    @staticmethod
    def train(texts: list[str], *, false_rate: float = 1e-5, least: float = 12.0, drawn: int = 4000, seed: int = 11) -> Model:
        import random

        import numpy as np

        rnd = random.Random(seed)
        sets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:64])
        secret = ["".join(rnd.choices(sets[n % len(sets)], k=rnd.randint(16, 44))) for n in range(drawn)]
        plain: tuple[list[str], list[str]] = ([], [])
        for n, text in enumerate(texts):
            spans = base_spans(text)
            secret += [x for k, a, b in spans if len(x := text[a:b]) >= LEAST_CHARS and k and _TOKEN.fullmatch(x)]
            for m in re.finditer(r"[A-Za-z0-9+/_=-]{4,}", text):
                if not any(a < m.end() and m.start() < b for _, a, b in spans):
                    plain[n % 2].append(m.group())
        # identifiers of these words and of the corpus's own, in the usual notations
        stock = [*IDENTIFIER_WORDS, *IDENTIFIER_WORDS, *(x.lower() for x in plain[0][:400] if x.isalpha() and len(x) < LEAST_CHARS)]

        def identifiers(count: int) -> list[str]:
            out = []
            for n in range(count):
                w = rnd.choices(stock, k=rnd.randint(2, 4))
                forms = ("_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "_".join(w).upper(), "/".join(w), f"{'_'.join(w)}_{n % 100}", "".join(w))
                out.append(forms[n % len(forms)])
            return out

        made, fresh = identifiers(2 * drawn), [t for t in identifiers(int(2 / false_rate)) if len(t) >= LEAST_CHARS]
        random_ones = Model.log_model(secret)

        def fitted(ordinary: list[str], held: list[str]) -> Model:
            model = Model(random_ones - Model.log_model(ordinary), least)
            for tokens in (fresh, held):
                if tokens:
                    s = np.sort(model.scores(tokens))[::-1]
                    model.threshold = max(model.threshold, float(s[min(len(s) - 1, int(false_rate * len(s)))]) + 1e-9)
            return model

        short, long = ([t for t in plain[0] if len(t) < LEAST_CHARS], [[t for t in half if len(t) >= LEAST_CHARS] for half in plain])
        # what no rule finds may still be a secret: it must neither teach the ordinary class nor lift the threshold
        first = fitted(made + short, [])
        long = [[t for t, s in zip(half, first.scores(half)) if s <= first.threshold or not _mixed(t)] for half in long]
        model = fitted(made + short + long[0], long[1])
        return model


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Tokens of each text beyond the threshold that touch no base span."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where, tokens, chars = [], [], 0

    def score():
        for (n, a, b), s in zip(where, model.scores(tokens)):
            if s > model.threshold:
                found[n].append((len(KINDS), a, b))
        where.clear()
        tokens.clear()

    for n, (text, base) in enumerate(zip(texts, bases)):
        taken = Taken([(a, b) for _, a, b in base])
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            if taken.free(a, b):
                where.append((n, a, b))
                tokens.append(m.group())
                chars += b - a
                if chars > 2_000_000:
                    score()
                    chars = 0
    score()
    return found


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train_docs: int = 2000, train_chars: int = 8_000_000) -> DataFrame:
    """Spans of secrets of every whole text, as digests and as a list."""
    model = docs.sparkSession.sparkContext.broadcast(Model.train(training_texts(docs, doc_id, text, rows=train_docs, chars=train_chars)))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                bases = [base_spans(t) for t in texts]
                out = []
                for base, more in zip(bases, added_spans(texts, bases, model.value)):
                    every = sorted(base + more, key=lambda x: (x[1], x[0]))
                    out.append((*(sum(k == i for k, _, _ in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(more)))
                columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), run, SCHEMA)
