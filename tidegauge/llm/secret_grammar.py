"""Secret scans: fixed patterns label credentials, and automata inferred from these score other tokens.

A first pass over the whole texts notes the credentials the fixed patterns find and every distinct token of
eight or more of their characters. From a bounded sample of the labelled credentials of each kind a prefix
tree is built, whose statistically compatible states are merged into a probabilistic automaton; all distinct
tokens of the corpus give a model of ordinary tokens, their counts of neighbouring characters. A second pass
scores every candidate token of every text under each automaton and under that model (without the token's own
share in it). A token is added as a span of kind ``grammar`` if it is as likely as the labelled credentials
are, and if it is likelier a credential than an ordinary token, at the odds at which the corpus holds the two.

Sample: per kind, the ``SAMPLE`` distinct credentials with the smallest hashes. That is the only
bound; counts, scanning and scoring cover all texts.

Defined results: a null or empty text has no spans; repeated rows get equal results and count once in the
model of ordinary tokens; with no labelled credential there is no automaton and nothing is added. No text
is shuffled, distinct tokens are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, fresh, quoted, slices
from tidegauge.session import through_table

# The patterns of the three base kinds, with the least length of what must match.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
ADDED = "grammar"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_MAY_HAVE_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

SAMPLE = 400
SIGNIFICANCE = 0.05
# Share of labelled credentials that may score below the threshold.
MISSED = 0.02

SPAN = "struct<kind:string,start:int,end:int,value:string>"
FOUND = f"doc_id long, base array<{SPAN}>, added array<{SPAN}>"
ORDER = {kind: k for k, kind in enumerate([*KINDS, ADDED])}

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns with the credential in each, by start and then kind."""
    spans = [
        ("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED
    ]
    spans += [
        ("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS
    ]
    spans += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Tokens of the characters of credentials that no base span touches."""
    if not base:
        return [(ADDED, m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text)]
    out, k = [], 0
    ordered = sorted((s[1], s[2]) for s in base)
    # a span may reach beyond the start of the next one
    reach = ordered[0][1]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(ordered) and ordered[k][0] < end:
            reach = max(reach, ordered[k][1])
            k += 1
        if not k or reach <= start:
            out.append((ADDED, start, end, m.group()))
    return out


def _spans_of(texts: pa.Array) -> Iterator[tuple[list[Span], list[Span]]]:
    may_base = pc.match_substring_regex(texts, _MAY_HAVE_BASE).to_pylist()
    for k, may in enumerate(may_base):
        text = texts[k].as_py()
        base = base_spans(text) if may else []
        yield base, candidate_spans(text, base)


def gather(docs: DataFrame) -> DataFrame:
    """``(kind, value)``: the distinct credentials of each base kind, and the distinct candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen = set()
                for base, other in _spans_of(part.column(1)):
                    seen.update((s[0], s[3]) for s in base)
                    seen.update((s[0], s[3]) for s in other)
                kinds, values = zip(*seen) if seen else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"]
                )

    return documents_of(docs).mapInArrow(run, "kind string, value string").distinct()


# --- grammar inference -------------------------------------------------------------------

# Symbols of the automata, and how many characters each stands for.
_CLASSES = [("0123456789", "d"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"),
            ("GHIJKLMNOPQRSTUVWXYZ", "U")]
_SYMBOL = {c: s for chars, s in _CLASSES for c in chars} | {c: c for c in "+/_.=-"}
_WIDTH = {s: len(chars) for chars, s in _CLASSES} | {c: 1 for c in "+/_.=-"}
_ALPHABET = len(_WIDTH)
_SMOOTHING = 0.1


def symbols(token: str) -> str:
    """The token with each character replaced by the symbol of its class."""
    return "".join(_SYMBOL[c] for c in token)


@dataclass
class State:
    visits: int = 0
    ends: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton merged from the prefix tree of the given tokens."""

    def __init__(self, tokens: list[str], significance: float = SIGNIFICANCE) -> None:
        self.states = [State()]
        for token in tokens:
            self._add(symbols(token))
        self._factor = math.sqrt(0.5 * math.log(2.0 / significance))
        self._merge()
        used = sorted(self._reachable())
        place = {old: new for new, old in enumerate(used)}
        self.states = [self.states[k] for k in used]
        for state in self.states:
            state.to = {s: place[k] for s, k in state.to.items()}
        scores = sorted(self.score(t) for t in tokens)
        self.threshold = scores[int(MISSED * len(scores))] - 1e-9
        self.shortest = min(len(t) for t in tokens)

    def _add(self, word: str) -> None:
        at = 0
        for s in word:
            state = self.states[at]
            state.visits += 1
            state.counts[s] = state.counts.get(s, 0) + 1
            if s not in state.to:
                state.to[s] = len(self.states)
                self.states.append(State())
            at = state.to[s]
        self.states[at].visits += 1
        self.states[at].ends += 1

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        """Whether two relative frequencies differ beyond the Hoeffding bound."""
        return abs(a / na - b / nb) > self._factor * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, red: int, blue: int) -> bool:
        stack = [(red, blue)]
        while stack:
            p, q = stack.pop()
            a, b = self.states[p], self.states[q]
            if not a.visits or not b.visits:
                continue
            if self._differ(a.ends, a.visits, b.ends, b.visits):
                return False
            for s in set(a.counts) | set(b.counts):
                if self._differ(a.counts.get(s, 0), a.visits, b.counts.get(s, 0), b.visits):
                    return False
            stack += [(a.to[s], b.to[s]) for s in a.to if s in b.to]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the state ``red`` and what follows it."""
        stack = [(red, blue)]
        while stack:
            p, q = stack.pop()
            a, b = self.states[p], self.states[q]
            a.visits += b.visits
            a.ends += b.ends
            for s, n in b.counts.items():
                a.counts[s] = a.counts.get(s, 0) + n
            for s, k in b.to.items():
                if s in a.to:
                    stack.append((a.to[s], k))
                else:
                    a.to[s] = k

    def _merge(self) -> None:
        """Compare each state next to the accepted ones with them, in order, and fold or accept it."""
        red = [0]
        while True:
            border = [
                (k, r, s) for r in red for s, k in sorted(self.states[r].to.items()) if k not in red
            ]
            if not border:
                return
            blue, parent, symbol = max(border, key=lambda x: (self.states[x[0]].visits, -x[0]))
            for state in red:
                if self._compatible(state, blue):
                    self.states[parent].to[symbol] = state
                    self._fold(state, blue)
                    break
            else:
                red.append(blue)

    def _reachable(self) -> set[int]:
        seen, stack = {0}, [0]
        while stack:
            for k in self.states[stack.pop()].to.values():
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        return seen

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character against evenly drawn characters."""
        at, total = 0, 0.0
        even = math.log(1 / sum(_WIDTH.values()))
        for s in symbols(token):
            state = self.states[at]
            share = (state.counts.get(s, 0) + _SMOOTHING) / (state.visits + _SMOOTHING * (_ALPHABET + 1))
            total += math.log(share / _WIDTH[s]) - even
            at = state.to.get(s, 0)
        state = self.states[at]
        total += math.log((state.ends + _SMOOTHING) / (state.visits + _SMOOTHING * (_ALPHABET + 1)))
        return total / max(1, len(token))

    def log_likelihood(self, token: str) -> float:
        return len(token) * (self.score(token) - math.log(sum(_WIDTH.values())))

    def accepts(self, token: str) -> bool:
        """Whether the token is as likely as the labelled credentials."""
        return len(token) >= self.shortest and self.score(token) >= self.threshold


# --- ordinary tokens ---------------------------------------------------------------------

# Code 0 stands before and after a token.
_CODES = np.zeros(256, np.int64)
_CODES[np.frombuffer("".join(_SYMBOL).encode(), np.uint8)] = np.arange(1, len(_SYMBOL) + 1)
_SIZE = len(_SYMBOL) + 1
# Log of the characters of each code's class: no automaton gives a character more than one in so many.
_LOG_WIDTH = np.array([0.0] + [math.log(_WIDTH[s]) for s in _SYMBOL.values()])
_PAIR_SMOOTHING = 0.5


def _pairs(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring codes of all tokens, as one number each, and the token each belongs to."""
    codes = _CODES[np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode(), np.uint8)]
    return codes[:-1] * _SIZE + codes[1:], np.cumsum(codes[:-1] == 0) - 1


def count_pairs(tokens: DataFrame) -> np.ndarray:
    """How often each pair of neighbouring characters stands in the distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.bincount(_pairs(batch.column(0).to_pylist())[0])
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                                                 names=["pair", "n"])

    found = tokens.select("value").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE * _SIZE)
    for row in found.collect():  # one row per pair of characters
        counts[row["pair"]] = row["n"]
    return counts


@dataclass
class Scorer:
    """Automata by kind, the pairs of ordinary tokens, and the log of their number over each kind's."""

    automata: dict[str, Automaton]
    pairs: np.ndarray
    odds: dict[str, float]

    def ordinary(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood of each token among all others of the corpus."""
        pair, owner = _pairs(tokens)
        first = pair // _SIZE
        _, at, times = np.unique(owner * (_SIZE * _SIZE) + pair, return_inverse=True, return_counts=True)
        _, from_at, from_times = np.unique(owner * _SIZE + first, return_inverse=True, return_counts=True)
        both = np.maximum(self.pairs[pair] - times[at], 0)
        one = np.maximum(self.pairs.reshape(_SIZE, _SIZE).sum(axis=1)[first] - from_times[from_at], 0)
        share = (both + _PAIR_SMOOTHING) / (one + _PAIR_SMOOTHING * _SIZE)
        return np.bincount(owner, np.log(share), len(tokens))

    def judge(self, tokens: list[str]) -> list[bool]:
        """Whether each token is a likely credential."""
        if not tokens or not self.automata:
            return [False] * len(tokens)
        ordinary = self.ordinary(tokens)
        pair, owner = _pairs(tokens)
        # the most that any automaton can give settles nearly all ordinary tokens
        most = -np.bincount(owner, _LOG_WIDTH[pair % _SIZE], len(tokens))
        verdicts = most >= ordinary + min(self.odds.values())
        for k in np.flatnonzero(verdicts):
            verdicts[k] = any(
                a.accepts(tokens[k]) and a.log_likelihood(tokens[k]) >= ordinary[k] + self.odds[kind]
                for kind, a in self.automata.items()
            )
        return verdicts.tolist()


def learn(tokens: DataFrame, sample: int = SAMPLE) -> Scorer:
    """An automaton for each kind of which there is a labelled credential, and the pairs of all candidates."""
    number = {r["kind"]: r["count"] for r in tokens.groupBy("kind").count().collect()}  # one row per kind
    automata, odds = {}, {}
    for kind in KINDS:
        rows = tokens.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        labelled = [r.value for r in rows.collect()]  # at most ``sample`` of them
        if labelled:
            automata[kind] = Automaton(labelled)
            odds[kind] = math.log(max(1, number.get(ADDED, 0)) / number[kind])
    return Scorer(automata, count_pairs(tokens.where(F.col("kind") == ADDED)), odds)


def learn_from(docs: DataFrame) -> Scorer:
    """What the first pass over the texts teaches."""
    return learn(through_table(gather(docs), "secret-tokens"))


# Verdicts a task remembers.
REMEMBERED = 500_000


def _judged(texts: pa.Array, scorer: Scorer, known: dict[str, bool]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and accepted candidates of every text."""
    spans = list(_spans_of(texts))
    new = list({s[3] for _, other in spans for s in other if s[3] not in known})
    if len(known) > REMEMBERED:
        known.clear()
        new = list({s[3] for _, other in spans for s in other})
    known.update(zip(new, scorer.judge(new)))
    for base, other in spans:
        yield base, [s for s in other if known[s[3]]]


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, added)`` of every document; scans the texts twice."""
    scorer = learn_from(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("value", pa.string())]))
        as_rows = lambda spans: [dict(zip(("kind", "start", "end", "value"), s)) for s in spans]
        known: dict[str, bool] = {}
        for batch in batches:
            for part in slices(batch):
                base, added = [], []
                for a, b in _judged(part.column(1), scorer, known):
                    base.append(as_rows(a))
                    added.append(as_rows(b))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"]
                )

    return documents_of(docs).mapInArrow(run, FOUND)


def joined(spans) -> F.Column:
    """``kind:start:end`` of the spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans) -> F.Column:
    """Spans by start and then kind in the fixed order."""
    order = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("s"), order[s["kind"]].alias("k"), s.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span, base and added, replaced by a mask; other columns stay."""
    scorer = learn_from(docs)
    (packed,) = fresh(docs, "_row")
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def clean(text: str | None, base: list[Span], other: list[Span]) -> str | None:
        spans = sorted((s[1], s[2]) for s in base + other)
        out, at = [], 0
        for start, end in spans:
            if end > at:
                out += [text[at:start], mask] if start >= at else []
                at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            for part in slices(batch):
                texts = part.column(0)
                filled = pc.fill_null(texts, "")
                new = [
                    clean(filled[k].as_py(), a, b) if a or b else None
                    for k, (a, b) in enumerate(_judged(filled, scorer, known))
                ]
                changed = pa.array([x is not None for x in new])
                yield pa.RecordBatch.from_arrays(
                    [pc.if_else(changed, pa.array(new, texts.type), texts), part.column(1)], names=["text", packed]
                )

    rest = [c for k, c in enumerate(docs.columns) if k != place]
    text = F.col("`" + docs.columns[place] + "`").cast("string").alias("text")
    frame = docs.select(text, F.struct(*quoted(rest), F.lit(0).alias(fresh(docs, "_pad")[0])).alias(packed))
    done = frame.mapInArrow(run, frame.schema)
    inner = {c: F.col(packed).getField(c).alias(c) for c in rest}
    return done.select(*[F.col("text").alias(c) if k == place else inner[c] for k, c in enumerate(docs.columns)])
