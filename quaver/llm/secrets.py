"""Secret scans: fixed rules, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import small_batches

# The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of AKIA[A-Z0-9]+ those of 20 and more: the run is taken whole either way
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
CANDIDATE_LEAST = 20
#: Characters after which a credential may begin within a run, and before which it may end.
JOINTS = "=/."
KINDS = ("assign", "access", "hex", "format")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the whole matches, leftmost and non-overlapping for each kind, in order."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def labelled_credentials(each: int = 150, seed: int = 42) -> dict[str, list[str]]:
    """Made-up credentials of public formats, and other long tokens under ``other``. Replace them with your own by argument."""
    r = random.Random(seed)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word, lower, upper, digits = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase, string.digits
    say = lambda: of(lower, r.randint(2, 9))
    formats = {
        "cloud": lambda: "AKIA" + of(upper + digits, 16),
        "forge": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + of(word, 36),
        "pay": lambda: r.choice(["sk_live_", "rk_live_"]) + of(word, 24),
        "maps": lambda: "AIza" + of(word + "_-", 35),
        "chat": lambda: f"xoxb-{of(digits, 12)}-{of(digits, 12)}-{of(word, 24)}",
        "web": lambda: ".".join(["eyJ" + of(word + "_-", r.randint(17, 40)), "eyJ" + of(word + "_-", r.randint(20, 60)), of(word + "_-", 43)]),
    }
    other = [
        lambda: of(lower, r.randint(20, 30)),
        lambda: say().capitalize() + "-" + say() + "-" + say() + "-" + say(),
        lambda: "/".join(["", say(), say(), say(), say()]),
        lambda: "_".join([say(), say(), say(), say()]),
        lambda: of(digits, r.randint(20, 24)),
        lambda: ".".join(["www", say() + say(), say() + say(), "com"]),
        lambda: "=" * r.randint(20, 40),
        lambda: "-" * r.randint(20, 60),
        lambda: say() + "." + say() + "." + say() + "." + say() + "." + say(),
    ]
    return {k: [f() for _ in range(each)] for k, f in formats.items()} | {"other": [r.choice(other)() for _ in range(each * 4)]}


def _symbol(c: str, at: int) -> str:
    """Letters of the automata: the first four characters as they are, then classes."""
    if at < 4:
        return c
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c


class Automaton:
    """A probabilistic automaton, by merging statistically compatible states of the prefix tree of its examples.

    Two states are compatible if their frequencies of ending and of each next symbol differ by less than a Hoeffding bound at
    level ``alpha``, and so do those of the states that follow. Merging folds the successors together.
    """

    def __init__(self, examples: list[str], alpha: float = 0.05) -> None:
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.total: list[int] = [0]
        self._steps: dict[tuple[int, str], tuple[int, float]] = {}
        for e in examples:
            s = 0
            self.total[s] += 1
            for i, c in enumerate(e):
                a = _symbol(c, i)
                if a not in self.next[s]:
                    self.next[s][a] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.total.append(0)
                self.seen[s][a] = self.seen[s].get(a, 0) + 1
                s = self.next[s][a]
                self.total[s] += 1
            self.ends[s] += 1
        self._infer()

    def _infer(self) -> None:
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            b = min(blue)
            for r in red:
                if self._compatible(r, b):
                    self._redirect(b, r)
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = {t for r in red for t in self.next[r].values()} - set(red)

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for a in self.seen[p].keys() | self.seen[q].keys():
                if self._differ(self.seen[p].get(a, 0), n, self.seen[q].get(a, 0), m):
                    return False
                if a in self.next[p] and a in self.next[q] and self.next[p][a] != p:
                    todo.append((self.next[p][a], self.next[q][a]))
        return True

    def _redirect(self, old: int, new: int) -> None:
        for t in self.next:
            for a, s in t.items():
                if s == old:
                    t[a] = new

    def _fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.ends[p] += self.ends[q]
            for a, n in list(self.seen[q].items()):
                self.seen[p][a] = self.seen[p].get(a, 0) + n
                if a in self.next[p]:
                    todo.append((self.next[p][a], self.next[q][a]))
                else:
                    self.next[p][a] = self.next[q][a]

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        """The next state and the symbol's log-likelihood; one never seen at a state has a small share, and the automaton stays where it is."""
        found = self._steps.get((state, symbol))
        if found is None:
            share = (self.seen[state].get(symbol, 0) + 0.01) / (self.total[state] + 1)
            found = self._steps[state, symbol] = (self.next[state].get(symbol, state), math.log(share))
        return found

    def ending(self, state: int) -> float:
        return math.log((self.ends[state] + 0.01) / (self.total[state] + 1))

    def log_likelihood(self, text: str) -> float:
        """Of the whole text."""
        s, out = 0, 0.0
        for i, c in enumerate(text):
            s, more = self.step(s, _symbol(c, i))
            out += more
        return out + self.ending(s)


class FormatScorer:
    """Scores candidates by their likelihood under the best format's automaton against that of other long tokens."""

    def __init__(self, labelled: dict[str, list[str]]) -> None:
        self.formats = {k: Automaton(v) for k, v in sorted(labelled.items()) if k != "other"}
        self.other = Automaton(labelled["other"])

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character; above 0: likelier a credential."""
        return (max(a.log_likelihood(token) for a in self.formats.values()) - self.other.log_likelihood(token)) / len(token)


def best_parts(run: str, scorer: FormatScorer, least: float) -> list[tuple[int, int]]:
    """The non-overlapping parts of ``run``, of CANDIDATE_LEAST and more characters, that score at least ``least``: those with the
    greatest sum of (score - least) * length.

    Parts begin and end at the run's ends and at JOINTS. A part's worth is a sum over its characters, so of the beginnings that
    have brought a format's automaton and the other one into the same states only the best goes on; this loses nothing once
    they are long enough, and the time grows with the run's length, not its square.
    """
    formats, other = list(scorer.formats.values()), scorer.other
    total, last = [0.0] * (len(run) + 1), [None] * (len(run) + 1)  # best sum up to each position, and the part that ends there
    young: list[tuple[int, list[int], list[float], int]] = []  # start, states and worth by format, other's state
    old: dict[tuple[int, int, int], tuple[float, int]] = {}  # (format, its state, other's state): best sum, start
    for i, c in enumerate(run):
        if i == 0 or (run[i - 1] in JOINTS and c not in JOINTS):
            young.append((i, [0] * len(formats), [total[i]] * len(formats), 0))
        grown: dict[tuple[int, int, int], tuple[float, int]] = {}
        class_ = _symbol(c, 4)
        for (k, s, o), (v, start) in old.items():
            s, up = formats[k].step(s, class_)
            o, down = other.step(o, class_)
            v += up - down - least
            if (k, s, o) not in grown or v > grown[k, s, o][0]:
                grown[k, s, o] = (v, start)
        still = []
        for start, states, worth, o in young:
            a = _symbol(c, i - start)
            o, down = other.step(o, a)
            for k, f in enumerate(formats):
                states[k], up = f.step(states[k], a)
                worth[k] += up - down - least
            if i + 1 - start < CANDIDATE_LEAST:
                still.append((start, states, worth, o))
                continue
            for k, (s, v) in enumerate(zip(states, worth, strict=True)):
                if (k, s, o) not in grown or v > grown[k, s, o][0]:
                    grown[k, s, o] = (v, start)
        young, old = still, grown
        total[i + 1] = total[i]
        if i + 1 == len(run) or run[i + 1] in JOINTS:
            for (k, s, o), (v, start) in old.items():
                v += formats[k].ending(s) - other.ending(o)
                if v > total[i + 1] or (v == total[i + 1] and last[i + 1] is None):
                    total[i + 1], last[i + 1] = v, start
    out, i = [], len(run)
    while i > 0:
        if last[i] is None:
            i -= 1
        else:
            out.append((last[i], i))
            i = last[i]
    return out[::-1]


class _Running:
    """The score of a growing part of a run, from one beginning."""

    def __init__(self, scorer: FormatScorer, run: str, start: int) -> None:
        self.run, self.start, self.end = run, start, start
        self.automata = [*scorer.formats.values(), scorer.other]
        self.at = [(0, 0.0)] * len(self.automata)

    def grown(self, end: int) -> _Running:
        out = object.__new__(_Running)
        out.run, out.start, out.end, out.automata, out.at = self.run, self.start, end, self.automata, []
        symbols = [_symbol(self.run[i], i - self.start) for i in range(self.end, end)]
        for f, (s, v) in zip(self.automata, self.at, strict=True):
            for c in symbols:
                s, more = f.step(s, c)
                v += more
            out.at.append((s, v))
        return out

    def score(self) -> float:
        done = [v + f.ending(s) for f, (s, v) in zip(self.automata, self.at, strict=True)]
        return (max(done[:-1]) - done[-1]) / (self.end - self.start)


def rejoined(run: str, parts: list[tuple[int, int]], scorer: FormatScorer, least: float) -> list[tuple[int, int]]:
    """``parts`` with those that one joint separates made one where the whole scores enough too, as for tokens with dots inside."""
    out: list[_Running] = []
    for a, b in parts:
        more = out[-1].grown(b) if out and a == out[-1].end + 1 else None
        if more is not None and more.score() >= least:
            out[-1] = more
        else:
            out.append(_Running(scorer, run, a).grown(b))
    return [(r.start, r.end) for r in out]


def scan(text: str, scorer: FormatScorer, least: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the best candidates that score at least ``least``.

    Every run is a candidate as a whole, whatever base spans lie in it, and so is what base spans leave of it. What a base span
    already covers is not named again.
    """
    base = base_spans(text)
    more, k = [], 0
    merged: list[list[int]] = []
    for _, a, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])

    def parts(a: int, b: int) -> list[tuple[int, int]]:
        if b - a < CANDIDATE_LEAST:
            return []
        return [(a + x, a + y) for x, y in rejoined(text[a:b], best_parts(text[a:b], scorer, least), scorer, least)]

    for m in CANDIDATE.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        j = k
        while j < len(merged) and merged[j][0] < m.end():
            j += 1
        within = merged[k:j]
        whole = [(a, b) for a, b in parts(m.start(), m.end()) if not any(x <= a and b <= y for x, y in within)]
        # the gaps between all of these: base spans and parts found
        at = m.start()
        for x, y in [*sorted([*map(tuple, within), *whole]), (m.end(), m.end())]:
            if within and x - at >= CANDIDATE_LEAST:
                more += [("format", a, b) for a, b in parts(at, x)]
            at = max(at, y)
        more += [("format", a, b) for a, b in whole]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span, overlapping ones together, by <REDACTED>."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "<REDACTED>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, labelled: dict[str, list[str]] | None = None, least: float = 0.25, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scan whole texts: ``keep`` columns, n_assign, n_access, n_hex, n_format, base_sha256, spans and redacted (null stays null).

    The automata are inferred on the driver from ``labelled`` (a few hundred strings of each format and of ``other`` tokens; see
    labelled_credentials) and score every run of 20 and more credential characters, and its parts (see best_parts), also where base rules match in it.
    Null texts count as empty: no spans, the digest of the empty string. Rows are independent: repeated rows, null ids and
    extra columns change nothing; an empty table gives an empty result. Spans count code points, ends exclusive.
    Very long texts and runs: the time grows with their length.
    """
    small_batches(docs.sparkSession)
    scorer = FormatScorer(labelled or labelled_credentials())
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for given in b["_text"]:
                text = given or ""
                base, spans = scan(text, scorer, least)
                n = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), None if given is None else redact(text, spans)))
            made = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "redacted"])
            for i, f in enumerate(fields):
                made.insert(i, f.name, b[f.name].astype("Int64").array if f.dataType.typeName() in ("long", "integer", "short", "byte") else b[f.name].array)
            yield made

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(
        run, f"{kept}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, redacted string"
    )
