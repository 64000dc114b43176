"""Secrets in texts: three fixed patterns, and formats learned from what these find.

The patterns' matches are the labelled credentials. A prefix tree of a bounded sample of them is folded into a
probabilistic automaton: two states merge if their symbols' and ends' frequencies, and those of what follows, are
statistically compatible (Hoeffding's bound). All other tokens of ``SHORTEST`` characters or more, of the characters that
a credential may have, are candidates, and all of them teach a model of ordinary tokens (which symbol follows which).
The candidates that the automaton makes enough likelier than that model does are added as spans of the kind ``learned``:
enough is what outweighs how many candidates there are for each labelled credential, ``CERTAIN`` times over, and
``MARGIN_EACH`` for each symbol. The ordinary model is fitted in rounds, each without the candidates that the one before
finds likelier to be credentials, so that these don't count as ordinary. Spans of the patterns always stay.

Credentials under ``SHORTEST`` characters or over ``LONGEST`` teach no format, and dots behind a candidate are no part of
it. Spans count code points, the end is exclusive. Null texts count as empty; very long texts are read in whole. Every
row gives one row, equal or null ids included. Other columns are not looked at. Without any credential nothing is added;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches
from millrace.session import written

# The three patterns with the least length of what counts, and the order of the kinds. A run of
# [0-9a-f] of 24 is the same as a match of {24,}; so it is behind AKIA, where a later start has a shorter tail.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Lengths of credentials that formats are learned from, and the sample of them. Tokens from the shortest on are scored.
SHORTEST, LONGEST, SAMPLE = 16, 96, 600
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}(?<!\.)" % SHORTEST)
#: All symbols of a token; the number behind the last stands for its ends.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: The test's confidence, and the visits under which a state is compatible with any.
ALPHA, VISITS = 0.05, 8
#: How many times likelier than not a candidate must be a secret, the least natural-log likelihood ratio, and what each
#: symbol needs.
CERTAIN, MARGIN, MARGIN_EACH = 100.0, 6.0, 0.25
#: What the ordinary model believes before it has seen tokens weighs as much as so many symbols behind each symbol.
BELIEF, ROUNDS = 32.0, 3


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the patterns' matches, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def other_tokens(text: str, base: list[tuple]) -> list[tuple[int, int, str]]:
    """Tokens that touch none of the spans."""
    starts = [span[0] for span in base]
    reach = [0, *accumulate((span[1] for span in base), max)]  # how far the spans before each one go
    found = ((m.start(), m.end(), m[0]) for m in TOKEN.finditer(text))
    return [t for t in found if reach[bisect_left(starts, t[1])] <= t[0]]


class Automaton:
    """States with counted symbols; "" is the end of a token."""

    def __init__(self, counts: list[dict[str, int]], to: list[dict[str, int]]):
        self.counts, self.to = counts, to
        self.totals = [sum(c.values()) for c in counts]

    def log_likelihood(self, token: str, symbols: int = len(SYMBOLS)) -> float:
        """Of a token; a symbol never seen in a state gets half a visit, and leads back to the start."""
        state, total = 0, 0.0
        for symbol in (*token, ""):
            n = self.counts[state].get(symbol, 0) if state >= 0 else 0
            total += math.log((n + 0.5 / symbols) / ((self.totals[state] if state >= 0 else 0) + 0.5))
            state = self.to[state].get(symbol, 0) if state >= 0 else 0
        return total


def compatible(n: int, of_n: int, m: int, of_m: int) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(of_n) + 1 / math.sqrt(of_m))
    return abs(n / of_n - m / of_m) < bound


def infer(tokens: dict[str, int]) -> Automaton:
    """Fold the prefix tree of counted tokens: from the start outwards, each state merges into the first compatible
    one before it, or stays."""
    counts: list[Counter] = [Counter()]
    to: list[dict[str, int]] = [{}]
    for token, n in sorted(tokens.items()):
        state = 0
        for symbol in token:
            counts[state][symbol] += n
            if symbol not in to[state]:
                to[state][symbol] = len(to)
                counts.append(Counter())
                to.append({})
            state = to[state][symbol]
        counts[state][""] += n

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(counts[a].values()), sum(counts[b].values())
            if n < VISITS or m < VISITS:
                continue
            if any(not compatible(counts[a][s], n, counts[b][s], m) for s in {*counts[a], *counts[b]}):
                return False
            todo += [(to[a][s], to[b][s]) for s in to[a] if s in to[b] and to[a][s] != to[b][s]]
        return True

    def fold(into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            counts[a].update(counts[b])
            for symbol, c in to[b].items():
                if symbol not in to[a]:
                    to[a][symbol] = c
                elif to[a][symbol] != c:
                    todo.append((to[a][symbol], c))

    settled, waiting = [0], [(0, s) for s in sorted(to[0])]
    while waiting:
        parent, symbol = waiting.pop(0)
        state = to[parent][symbol]
        if state in settled:
            continue
        for other in settled:
            if alike(other, state):
                to[parent][symbol] = other
                fold(other, state)
                waiting += [(other, s) for s in sorted(to[other]) if to[other][s] not in settled
                            and (other, s) not in waiting]
                break
        else:
            settled.append(state)
            waiting += [(state, s) for s in sorted(to[state])]
    number = {state: n for n, state in enumerate(settled)}
    return Automaton([dict(counts[s]) for s in settled],
                     [{c: number[t] for c, t in to[s].items() if t in number} for s in settled])


class Ordinary:
    """Which symbol follows which in ordinary tokens; ``counts`` has (symbol, next symbol, times).

    A token is judged by all others: what it may have added to the counts itself is left out.
    """

    def __init__(self, counts: list[tuple[int, int, int]] = ()):
        n = len(SYMBOLS)
        # Before anything is seen: mostly lower-case letters, few others, an end after ten symbols or so.
        belief = np.array([0.9 / 26 if c.islower() else 0.06 / 26 if c.isalpha() else 0.04 / 16 for c in SYMBOLS] + [0.1])
        self.belief = BELIEF * belief / belief.sum()
        self.table = np.zeros((n + 1, n + 1))
        for a, b, times in counts:
            self.table[a, b] += times
        self.totals = self.table.sum(axis=1)

    def log_likelihood(self, token: str) -> float:
        n = len(SYMBOLS)
        at = np.array([n, *map(PLACE.__getitem__, token), n])
        a, b = at[:-1], at[1:]
        _, which, own = np.unique(a * (n + 1) + b, return_inverse=True, return_counts=True)
        seen = np.maximum(self.table[a, b] - own[which], 0) + self.belief[b]
        of = np.maximum(self.totals[a] - np.bincount(a)[a], 0) + BELIEF
        return float(np.log(seen / of).sum())


PLACE = {c: n for n, c in enumerate(SYMBOLS)}
BEFORE = Ordinary()


def ratio(automaton: Automaton, token: str, ordinary: Ordinary = BEFORE) -> float:
    """How much likelier the automaton makes the token than the ordinary model."""
    return automaton.log_likelihood(token) - ordinary.log_likelihood(token)


class Judge:
    """Tells which candidates are secrets; ``margin`` is the least ratio of any."""

    def __init__(self, automaton: Automaton, ordinary: Ordinary, margin: float):
        self.automaton, self.ordinary, self.margin = automaton, ordinary, margin

    def __call__(self, token: str) -> bool:
        return ratio(self.automaton, token, self.ordinary) >= max(self.margin, MARGIN_EACH * len(token))


def followers(found: DataFrame, judge: Judge | None) -> list[tuple[int, int, int]]:
    """How often each symbol follows each in all candidates that ``judge`` does not take for secrets."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(SYMBOLS) + 1
        table = np.zeros(n * n, np.int64)
        for token in batch.column("token").to_pylist():
            if judge is None or not judge(token):
                at = np.array([n - 1, *map(PLACE.__getitem__, token), n - 1])
                np.add.at(table, at[:-1] * n + at[1:], 1)
        seen = np.flatnonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (seen // n, seen % n, table[seen])], ["a", "b", "n"])

    counted = batches.map_batches(found.select(F.explode("tokens.token").alias("token")), count, "a bigint, b bigint, n bigint")
    # A row for each pair of symbols at most.
    return [tuple(r) for r in counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()]


FOUND = ("doc_id bigint, base array<struct<s: bigint, e: bigint, kind: string, credential: string>>, "
         "tokens array<struct<s: bigint, e: bigint, token: string>>")


def look(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): the patterns' spans, and the tokens that touch none."""
    span = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string()), ("credential", pa.string())])
    other = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("token", pa.string())])

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, tokens = [], []
        for text in batches.texts(batch).to_numpy(zero_copy_only=False):
            own = base_spans(text)
            spans.append([dict(zip(("s", "e", "kind", "credential"), x)) for x in own])
            tokens.append([dict(zip(("s", "e", "token"), x)) for x in other_tokens(text, own)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span)),
                                           pa.array(tokens, pa.list_(other))], ["doc_id", "base", "tokens"])

    return batches.map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), found, FOUND)


def learn(found: DataFrame, sample: int = SAMPLE) -> Automaton | None:
    """The automaton of a bounded sample of the distinct credentials, those with the smallest hashes."""
    credential = F.regexp_replace("c", r"\.+$", "")
    rows = (found.select(F.explode("base.credential").alias("c")).select(credential.alias("c"))
            .filter(F.length("c").between(SHORTEST, LONGEST)).groupBy("c").agg(F.count("*").alias("n"))
            .orderBy(F.xxhash64("c"), "c").limit(sample).collect())
    return infer({r["c"]: 1 for r in rows}) if rows else None


def fitted(found: DataFrame, sample: int = SAMPLE) -> Judge | None:
    """The judge of a table's candidates; None where there are no credentials to learn from."""
    automaton = learn(found, sample)
    if automaton is None:
        return None
    many = found.agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size("base")).alias("base")).first()
    margin = max(MARGIN, math.log((many["tokens"] + 1) / (many["base"] + 1)) + math.log(CERTAIN))
    ordinary = None
    for _ in range(ROUNDS):
        ordinary = Ordinary(followers(found, Judge(automaton, ordinary, 0.0) if ordinary else None))
    return Judge(automaton, ordinary, margin)


def text_of(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans). The spans are written once; texts are read once."""
    found = written(look(docs), "spans")
    judge = fitted(found)

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, tokens in zip(batch.column("base").to_pylist(), batch.column("tokens").to_pylist()):
            base = [(x["s"], x["e"], x["kind"]) for x in base]
            added = [(t["s"], t["e"], "learned") for t in tokens if judge is not None and judge(t["token"])]
            n = Counter(kind for *_, kind in base)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(text_of(base).encode()).hexdigest(),
                         text_of(base + added)))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c) for c in columns[3:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return batches.map_batches(found, judged, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                              "base_sha256 string, spans string")
