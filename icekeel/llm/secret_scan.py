"""Secret scans: base patterns, and Markov models of random strings against ordinary identifiers.

Two second-order character models, one trained on random strings and one on ordinary identifiers (names, paths,
dates, identifiers and digests in hexadecimal, encoded words), score every long run of key-like characters. A run whose
log-likelihood ratio per character is over THRESHOLD, and that mixes letters with digits or small letters with
capitals, is a secret of kind "markov". Of other runs, the stretches of LEAST characters or
more that are so are: keys glued to names or paths.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import batched, sliced, texts

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of a run, or of a stretch of it, that the models judge.
LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Nats per character by which a run must be likelier under the random model.
THRESHOLD = 1.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Stems of ordinary identifiers.
STEMS = (
    "account address alert application archive array background balance batch buffer button cache callback channel "
    "character client column command comment compile config connection container content context control counter "
    "customer database default delete delivery description device dictionary directory document element encoding "
    "endpoint error event example exception execution export factory feature field filter folder format function "
    "generator graph handler header history identifier image import index information input instance integer internal "
    "interface iterator language layout length library license limit listener location logging manager mapping message "
    "method metric module monitor network number object offset operation option order output package parameter parser "
    "partition password pattern payment performance position previous process product profile project property "
    "protocol provider query queue random range reader record reference register release report repository request "
    "resource response result schedule schema search section security selection sequence server service session "
    "settings shipping snapshot source statement status storage stream string structure subscription summary system "
    "table target template thread timeout timestamp transaction transform update upload user utility validation value "
    "variable vector version view window worker writer "
    "add all and any api app bit by class code cpu css data day db dir do doc end env file first for from get group has hash host html http id in "
    "init is item job json key last line link list local lock log main make map max menu min mode name new next node not null of on open or os "
    "page part path pdf port put read role root row rule run set size slot sort sql ssl start state step stop sub sync tag task test text time to "
    "top tree true type unit uri url use utf var web with write xml year zip zone"
).split()


UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets of random strings, and what some keys begin with.
ALPHABETS = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, UPPER + LOWER)
PREFIXES = ("", "", "", "sk_live_", "ghp_", "glpat-", "xoxb-{}-{}-", "AIza", "key-", "npm_", "SG-")


def _ordinary(r: random.Random, kind: int) -> str:
    """An ordinary string of one of 18 kinds."""
    words = [r.choice(STEMS) for _ in range(r.randint(2, 6))]
    number = str(r.randint(0, 2030))
    hexes = lambda n: f"{r.getrandbits(4 * n):0{n}x}"
    if kind < 6:
        joined = ("_".join(words), "-".join(words), "".join(w.title() for w in words), "/".join(words), "".join(words), "_".join(words).upper())[kind]
        return joined + (number if r.random() < 0.5 else "")
    if kind == 6:
        return "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    if kind == 7:
        return f"{r.choice(words)}-" + "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    if kind == 8:
        return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}Z"
    if kind == 9:
        return hexes(r.choice((32, 40, 64))).upper() if r.random() < 0.5 else f"sha256-{hexes(40)}"
    if kind == 10:
        return base64.b64encode(" ".join(words).encode()).decode()
    if kind == 11:
        return "/".join([*words, f"v{r.randint(1, 9)}", f"{r.choice(STEMS)}-{number}-{r.randint(0, 99)}"])
    if kind == 12:
        return "=".join([*words[:2], number]) + "_" + "=".join(words[2:4])
    if kind == 13:
        return "".join(r.choice((w, w.title(), w.upper(), w[:3], w[0])) + r.choice(("", "", "_", str(r.randint(0, 9)))) for w in [*words, *words])
    if kind == 14:
        return "-".join(str(r.randint(0, 9999)) for _ in range(r.randint(4, 9)))
    if kind == 15:
        name = r.choice((r.choice(words).title(), r.choice(words)[:3].upper(), r.choice(words).title() + r.choice(words)[:3].upper(), r.choice(words)))
        version = r.choice("_-").join(str(r.randint(0, 20)) for _ in range(r.randint(2, 4))) + r.choice(("", "a", "b", "k", "rc1"))
        return f"{name}_{version}-{r.choice(words)}_{r.randint(1, 31)}_{r.choice(words)[:3].title()}_{r.randint(1990, 2030)}"
    if kind == 16:
        return f"{r.choice(words)[:3].upper()}_{r.randint(1990, 2030)}{r.randint(1, 12):02}{r.randint(1, 28):02}_{r.randint(0, 235959):06}_{'_'.join(words[:2])}"
    return r.choice("-=_+/") * r.randint(20, 80)


def labelled_samples(seed: int = 7, n: int = 12_000) -> Iterator[tuple[str, int]]:
    """(string, label) samples: 1 for random strings, 0 for ordinary ones."""
    r = random.Random(seed)
    for i in range(n):
        number = r.randint(10**9, 10**12)
        yield r.choice(PREFIXES).format(number, number + r.randint(1, 10**9)) + "".join(r.choices(ALPHABETS[i % len(ALPHABETS)], k=r.randint(20, 64))), 1
        yield _ordinary(r, i % 18), 0


PLACE = {c: k for k, c in enumerate(ALPHABET)}
START = len(ALPHABET)


class Markov:
    """A second-order character model; pairs that are rare lean on the single character before, and that on all."""

    def __init__(self, strings: Iterable[str]):
        n = len(ALPHABET)
        three, two, one = np.zeros((n + 1, n + 1, n)), np.zeros((n + 1, n)), np.ones(n)
        for s in strings:
            a = b = START
            for c in map(PLACE.__getitem__, s):
                three[a, b, c] += 1
                two[b, c] += 1
                one[c] += 1
                a, b = b, c
        p1 = one / one.sum()
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)
        self.logs = np.log(p3)


@lru_cache(1)
def steps() -> list[list[list[float]]]:
    """The log-likelihood ratio of each character after each two, random over ordinary."""
    samples = list(labelled_samples())
    rand, plain = (Markov(s for s, y in samples if y == label) for label in (1, 0))
    return (rand.logs - plain.logs).tolist()


def ratios(s: str) -> list[float]:
    """The log-likelihood ratio of each character of a run."""
    by, a, b, out = steps(), START, START, []
    for c in map(PLACE.__getitem__, s):
        out.append(by[a][b][c])
        a, b = b, c
    return out


def ratio(s: str) -> float:
    """Log-likelihood ratio per character, random over ordinary."""
    return sum(ratios(s)) / len(s)


def mixed(s: str) -> bool:
    """Whether a string mixes letters with digits, or goes from small letters to capitals often, as words joined together don't."""
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False))
    return turns >= 3 or any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _peaks(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches by their sums of scores, disjoint, in one pass (after Ruzzo and Tompa)."""
    held: list[tuple[float, float, int, int]] = []  # sum before, sum with it, start, end
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = i, before
        while held:
            k = len(held) - 1
            while k >= 0 and held[k][0] >= low:
                k -= 1
            if k < 0 or held[k][1] >= total:
                break
            low, start = held[k][0], held[k][2]
            del held[k:]
        held.append((low, total, start, i + 1))
    return [(a, b) for _, _, a, b in held]


def stretches(s: str) -> list[tuple[int, int]]:
    """(start, end) of what is random-like in a run: all of it, or else disjoint stretches of LEAST characters or more.

    Every stretch of a maximal sum of ratios is judged as it extends to the next = / _ - + on either
    side, without ordinary words at its ends, then as it is.
    """
    by = ratios(s)
    sums = [0.0, *accumulate(by)]

    def random_like(a: int, b: int) -> bool:
        return b - a >= LEAST and sums[b] - sums[a] > THRESHOLD * (b - a) and mixed(s[a:b])

    if random_like(0, len(s)):
        return [(0, len(s))]
    out, low = [], 0
    for a, b in _peaks(by):
        if b - a < LEAST // 2 or b <= low:
            continue
        c, d = max(a, low), b
        while c > low and s[c - 1] not in "=/_-+":
            c -= 1
        while d < len(s) and s[d] not in "=/_-+":
            d += 1
        # Words at its ends that are ordinary by themselves aren't in it.
        while (cut := next((i for i in range(c, min(d, b)) if s[i] in "=/_-+"), 0)) and sums[cut] <= sums[c]:
            c = cut + 1
        while (cut := next((i for i in range(d - 1, c, -1) if s[i] in "=/_-+"), 0)) and sums[d] <= sums[cut + 1]:
            d = cut
        found = next(((x, y) for x, y in ((c, d), (max(a, low), b)) if random_like(x, y)), None)
        if found:
            out.append(found)
            low = found[1]
    return out


def secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind; spans of different kinds may overlap."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    for m in RUN.finditer(text):
        s = m[0]
        out += [(m.start() + h.start(), m.start() + h.end(), "hex") for h in HEX.finditer(s)]
        if mixed(s):
            for c, d in ((m.start() + c, m.start() + d) for c, d in stretches(s)):
                if not any(a <= c and d <= b for a, b, k in out if k != "markov"):
                    out.append((c, d, "markov"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive. A null or empty text has none: zero
    counts, the digest of the empty string, spans "". Rows are independent of each other, so
    repeated rows repeat their result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [secrets(t) for t in texts(batch.column(1))]
            counts = [pa.array([sum(k == kind for *_, k in s) for s in found], pa.int64()) for kind in KINDS]
            base = [hashlib.sha256(_named([x for x in s if x[2] != "markov"]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(_named, found), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """text with every secret replaced by mark; overlapping ones by one mark."""
    out, at = [], 0
    for a, b, _ in secrets(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in text redacted and n_chars, if there, brought in line; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            old = batch.column("text").to_pylist()
            new = [t and redacted(t) for t in old]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if t == u else len(u) for k, t, u in zip(kept, old, new, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return batched(docs).mapInArrow(run, docs.schema)
