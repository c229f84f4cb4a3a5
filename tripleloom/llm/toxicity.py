"""Toxicity by a gap-weighted subsequence string kernel, a support vector machine and Nyström landmarks.

A sentence is a bag of units: its words, runs of single letters joined (``i d i o t``, with punctuation between and around them), when texts
are scored also short words joined with their neighbours (``id iot``), and, where labels show that words are toxic only together, pairs of neighbouring words. A sentence's score is the largest of its units', a document's
the largest of its sentences' (multiple-instance learning: of a toxic training document one unit need be toxic).

The features of a unit are all subsequences of ``P`` characters, of any script, that fit in a window of ``WINDOW``,
each gap costing a factor ``DECAY``; so ``idxiot`` and ``id.iot`` stay close to ``idiot``. The kernel is their normalised inner product, at any length.

Labels may be wrong: a unit's evidence is how much oftener it stands in toxic than in clean texts (Dunning's likelihood ratio), not its absence from clean ones, and an insult that some text
labelled clean holds is a negative with no more weight than that share of clean texts.

Landmarks Z give the Nyström features K(x, Z) K(Z, Z)^(-1/2). The machine is linear in them, and the
kernel is an inner product of explicit subsequence counts, so after training everything folds, exactly,
into one weight per subsequence of the landmarks: scoring a unit is a short sum of table lookups, shared by all landmarks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ready

P, WINDOW, DECAY = 3, 6, 0.55
#: Places of the second and third character of a subsequence after its first, and its weight.
SHAPES = [(a, b, DECAY ** (b - P + 1)) for b in range(2, WINDOW) for a in range(1, b)]
LONG, PART = 64, 100_000  # units beyond LONG characters are spelt out one by one, PART characters at a time
EVIDENCE, PAIR_EVIDENCE = 15.0, 25.0  # likelihood ratios that about one in 20,000, or in 3 million, units without meaning reach
MAX_TOXIC, MAX_CLEAN, MAX_CHARS, BACKGROUND, HARD, LANDMARKS, ROUNDS = 3000, 6000, 30_000_000, 6000, 3000, 160, 3
SENTENCE = re.compile(r"[.!?\n]+")
SPACED = re.compile(r"(?<![^\W_])(?<![@$])[^\W_](?:(?:[^\w@$]|_)+(?:[^\W_]|[@$])){2,}(?![^\W_]|[@$])")
STOP = re.compile(r"[.!?;:]+\s+")
ENDS = (".", "!", "?")
BRIEF, JOINED = 3, 16  # a word of up to so many letters is joined with its neighbours, up to so many characters
JOINS_WRONGLY, WRONGLY, FEW, FLOOR = 1000, 10.0, 30, 0.5
LEET = str.maketrans("013457@$", "oieastas")
SEPARATORS = re.compile(r"(?:[^\w@$]|_)+")
NOT_LETTER = re.compile(r"[\W\d_]+")
CACHE = 600_000
RIDGE = 0.1


def unit(token: str) -> str:
    """A token's letters: punctuation at its ends goes, digits and signs inside are read as the letters they imitate."""
    core = token.strip("!?.,;:%&$#*|\"'()[]{}<>-_~/\\+=")
    if core.isalpha():
        return core
    return NOT_LETTER.sub("", core.translate(LEET) if any(c.isalpha() for c in core) else "")


def spaced(low: str) -> set[str]:
    """Runs of spaced-out letters joined: whole, and the parts between stops, for the last letter of a sentence may stand before another."""
    out = set()
    for run in SPACED.findall(low):
        out.add(SEPARATORS.sub("", run))
        out.update(SEPARATORS.sub("", x) for x in STOP.split(run))
    return out


def joins(own: list[str], brief: set[str]) -> set[str]:
    """Tokens of ``brief`` joined with the one before and the one after, within sentences."""
    out, last = set(), len(own) - 1
    for k, t in enumerate(own):
        if t in brief:
            if k and not own[k - 1].endswith(ENDS) and len(own[k - 1]) + len(t) <= JOINED:
                out.add(own[k - 1] + t)
            if k < last and not t.endswith(ENDS) and own[k + 1] not in brief and len(own[k + 1]) + len(t) <= JOINED:
                out.add(t + own[k + 1])
    return out


def tokens(text: str) -> set[str]:
    """Distinct raw tokens of a text, with runs of spaced-out letters joined as further tokens."""
    low = text.lower()
    return set(low.split()) | spaced(low)


def pairs_of(text: str) -> list[str]:
    """Units of two neighbouring words of a sentence."""
    out = []
    for sentence in SENTENCE.split(text.lower()):
        own = [u for t in sentence.split() if (u := unit(t))]
        out += [f"{x} {y}" for x, y in zip(own, own[1:])]
    return out


def _points(units: list[str]) -> np.ndarray:
    """Code points of units of one length, each after a mark of its beginning."""
    return np.frombuffer("".join("^" + u for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1).astype(np.int64)


def _spell(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids [n, g], weights [g]) of all subsequences of rows of code points; an id holds the three code points."""
    n = c.shape[1]
    ids = [c[:, : n - b] << 42 | c[:, a : n - b + a] << 21 | c[:, b:] for a, b, _ in SHAPES if b < n]
    w = [np.full(n - b, x, np.float32) for _, b, x in SHAPES if b < n]
    return (np.concatenate(ids, 1), np.concatenate(w)) if ids else (np.zeros((len(c), 0), np.int64), np.zeros(0, np.float32))


def features(u: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct subsequence ids, their weights) of one unit of any length."""
    c = _points([u])
    ids, w = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, c.shape[1], PART):
        part = c[:, lo : lo + PART + WINDOW - 1]
        for a, b, x in SHAPES:  # of the overlap, only what begins before it
            n = min(PART, part.shape[1] - b)
            if n > 0:
                new, many = np.unique(part[0, :n] << 42 | part[0, a : a + n] << 21 | part[0, b : b + n], return_counts=True)
                ids, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
                w = np.bincount(at, np.concatenate([w, many * x]))
    return ids, w


def _norms(units: list[str], c: np.ndarray) -> np.ndarray:
    """Length of each unit's feature vector, where a subsequence may occur at several places: the square root of the kernel of a unit with itself."""
    if c.shape[1] > LONG:
        return np.array([np.sqrt((features(u)[1] ** 2).sum()) for u in units])
    ids, w = _spell(c)
    order = np.argsort(ids, axis=1)
    own, weight = np.take_along_axis(ids, order, 1), w[order]
    new = np.ones(own.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
    return np.sqrt(np.add.reduceat(sums**2, np.r_[0, new.sum(1).cumsum()[:-1]]))


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(places in units, those units, their code points), units of one length at a time and of more than two characters with the mark."""
    by: dict[int, list[int]] = defaultdict(list)
    for k, u in enumerate(units):
        by[len(u)].append(k)
    for n, at in by.items():
        if n + 1 >= P:
            step = max(1, 64_000 // n)
            for lo in range(0, len(at), step):
                own = [units[k] for k in at[lo : lo + step]]
                yield np.array(at[lo : lo + step]), own, _points(own)


@dataclass
class Grams:
    """Numbers, from 1, of the subsequences of some units, found by the codes of their characters."""

    points: np.ndarray  # code points, whose codes are 1, 2 ...
    first: np.ndarray  # [codes * codes] of two characters: the number of the pair, 0 if there is none
    third: np.ndarray  # [pairs * codes] of a pair and a character: the number of the subsequence, 0 if there is none

    @classmethod
    def of(cls, units: list[str]) -> tuple[Grams, list[tuple[np.ndarray, np.ndarray]]]:
        """And for each unit the numbers of its subsequences and their weights."""
        own = [features(u) for u in units]
        ids = np.unique(np.concatenate([x for x, _ in own]))
        split = [ids >> 42, ids >> 21 & 0x1FFFFF, ids & 0x1FFFFF]
        points = np.unique(np.concatenate(split))
        n = len(points) + 1
        x, y, z = (np.searchsorted(points, p) + 1 for p in split)
        two, pair = np.unique(x * n + y, return_inverse=True)
        first, third = np.zeros(n * n, np.int32), np.zeros((len(two) + 1) * n, np.int32)
        first[two] = np.arange(1, len(two) + 1)
        third[(pair + 1) * n + z] = np.arange(1, len(ids) + 1)
        return cls(points, first, third), [(np.searchsorted(ids, i) + 1, w) for i, w in own]

    @cached_property
    def codes(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[self.points] = np.arange(1, len(self.points) + 1)
        return out

    def find(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """For code points [n, length], by shape: the places in ``third`` of the subsequences [n, ...] and their weight."""
        n, code = len(self.points) + 1, self.codes[c]
        length = c.shape[1]
        for a in range(1, WINDOW - 1):
            if a + 1 < length:
                two = self.first[code[:, :-a] * n + code[:, a:]] * n
                for x, b, w in SHAPES:
                    if x == a and b < length:
                        yield two[:, : length - b] + code[:, b:], w


@dataclass
class Model:
    grams: Grams
    weight: np.ndarray  # float32, along grams.third
    bias: float
    threshold: float
    margin: float = 0.0  # how much further above the threshold joins of short words must be
    pairs: bool = False  # whether pairs of words are units

    @property
    def floor(self) -> float:
        """Scores aren't told apart below this."""
        return self.threshold - FLOOR

    def score(self, units: list[str]) -> np.ndarray:
        """Scores; those that can't reach the floor are that, and those of units too short for a subsequence minus infinity."""
        floor = self.floor
        out = np.full(len(units), -np.inf, np.float32)
        for at, own, c in by_length(units):
            dot = sum(w * self.weight[k].sum(1, dtype=np.float64) for k, w in self.grams.find(c))
            # The norm is at least that of the weights alone; so most units are known to be far below without it.
            least = np.sqrt(sum(w * w * max(0, c.shape[1] - b) for _, b, w in SHAPES))
            unsure = np.flatnonzero(np.maximum(dot, 0) / least + self.bias > floor)
            out[at] = floor
            if len(unsure):
                out[at[unsure]] = np.maximum(dot[unsure] / _norms([own[k] for k in unsure], c[unsure]) + self.bias, floor)
        return out

    def digest(self) -> bytes:
        return xxhash.xxh128_digest(b"".join(x.tobytes() for x in (self.weight, self.grams.points)) + repr((self.bias, self.threshold, self.margin, self.pairs)).encode())


def _kernel(units: list[str], grams: Grams, marks: np.ndarray) -> np.ndarray:
    """Kernel of units with landmarks, whose normalised features are the columns of marks, along the numbers of grams."""
    out = np.zeros((len(units), marks.shape[1]), np.float32)
    for at, own, c in by_length(units):
        norm = _norms(own, c)
        step = max(1, 30_000 // c.shape[1])
        for lo in range(0, len(at), step):
            k = slice(lo, lo + step)
            for ids, w in grams.find(c[k]):
                out[at[k]] += w * marks[grams.third[ids]].sum(1)
            out[at[k]] /= norm[k, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge linear machine with a bias column, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = ridge * 1e-3
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        g = reg * w - 2 * (x[on] * (cost[on] * y[on] * margin[on])[:, None]).sum(0)
        h = np.diag(reg) + 2 * (x[on] * cost[on][:, None]).T @ x[on]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _threshold(toxic: np.ndarray, clean: np.ndarray, wrongly: float = WRONGLY) -> float:
    """Where the share of toxic texts found, less ``wrongly`` times the share of clean ones rejected, is largest; of equal places, the widest gap, a quarter of the way up, for bent words score lower than plain ones."""
    t, c = np.sort(toxic), np.sort(clean)
    cuts = np.unique(np.r_[t, c])
    gain = (len(t) - np.searchsorted(t, cuts)) / len(t) - wrongly * (len(c) - np.searchsorted(c, cuts)) / len(c)
    below = np.r_[cuts[0] - 1, cuts[:-1]]
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = best[(cuts - below)[best].argmax()]
    return float(below[k] + (cuts[k] - below[k]) / 4)


def _joined(texts: list[str], model: Model, pairs: bool, least: float = -np.inf):
    """For each text its joins' units, or its pairs, with scores of at least ``least``; a few texts at a time, as these are many."""
    for lo in range(0, len(texts), 200):
        if pairs:
            sets = [set(pairs_of(t)) for t in texts[lo : lo + 200]]
        else:
            own = [x.lower().split() for x in texts[lo : lo + 200]]
            brief = {t for t in set().union(*own) if 0 < len(unit(t)) <= BRIEF}
            sets = [{u for t in joins(x, brief) if len(u := unit(t)) >= 3} for x in own]
        units = sorted(set().union(*sets))
        high = {u: v for u, v in zip(units, model.score(units).tolist()) if v >= least}
        yield from ({u: high[u] for u in x if u in high} for x in sets)


def evidence(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Likelihood ratio for units in t toxic and c clean texts of so many, negative for those likelier in clean ones."""

    def part(x, n):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(n, 1e-12)), 0.0)

    t, c = t.astype(float), c.astype(float)
    p = (t + c) / (n_toxic + n_clean)
    g = 2 * (part(t, n_toxic * p) + part(c, n_clean * p) + part(n_toxic - t, n_toxic * (1 - p)) + part(n_clean - c, n_clean * (1 - p)))
    return np.where(t / n_toxic > c / n_clean, g, -g)


class Bags:
    """Texts as arrays of unit numbers: ``own`` are the distinct units of three letters or more of each, ``rows`` all in order, -1 between sentences."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.own, self.rows = [], []
        for text in texts:
            low = text.lower()
            row = []
            for t in low.split():
                if u := unit(t):
                    row.append(number.setdefault(u, len(number)))
                if t.endswith(ENDS):
                    row.append(-1)
            more = [number.setdefault(u, len(number)) for x in spaced(low) if (u := unit(x))]
            self.rows.append(np.array(row, np.int32))
            self.own.append(np.unique(np.array(row + more, np.int32)))
        self.units = list(number)
        long_enough = np.array([len(u) >= 3 for u in self.units] + [False])  # -1 is the last
        self.own = [x[long_enough[x]] for x in self.own]

    def count(self, chosen: list[int]) -> np.ndarray:
        """In how many of the chosen texts each unit stands."""
        out = np.zeros(len(self.units), np.int64)
        for k in chosen:
            out[self.own[k]] += 1
        return out

    def distinct(self, chosen: list[int]) -> list[int]:
        """The chosen texts without near copies of earlier ones, which would count as evidence again: those that share the least of their hashed runs of five words, by one of four hash functions."""
        seen: set[tuple[int, int]] = set()
        out = []
        for k in chosen:
            x = self.rows[k].astype(np.uint64)
            for _ in range(min(4, len(x) - 1)):
                x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:]
            keys = {(j, int(((x ^ (x >> np.uint64(29))) * np.uint64(m)).min())) for j, m in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)) if len(x)}
            if not keys & seen:
                out.append(k)
            seen |= keys
        return out

    def pairs(self, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(first * units + second, in how many of the chosen texts) of pairs of neighbours."""
        found = [np.zeros(0, np.int64)]
        for k in chosen:
            x = self.rows[k].astype(np.int64)
            ok = (x[:-1] >= 0) & (x[1:] >= 0)
            found.append(np.unique(x[:-1][ok] * len(self.units) + x[1:][ok]))
        return np.unique(np.concatenate(found), return_counts=True)


def _machine(texts: list[str], bags: Bags, toxic: list[int], clean: list[int], landmarks: int, background: int, hard: int, rounds: int, seed: int) -> Model | None:
    """A model, yet without a threshold, of the texts of these numbers; None if no unit speaks for toxic texts, or none for clean ones."""
    units = bags.units
    t, c = bags.count(toxic), bags.count(clean)
    proof = evidence(t, c, len(toxic), len(clean))
    # Pairs of words that say more together than either alone.
    code, many = bags.pairs(toxic)
    code, many = code[many >= 4], many[many >= 4]
    all_code, all_many = bags.pairs(clean)
    at = np.minimum(np.searchsorted(all_code, code), max(0, len(all_code) - 1))
    in_clean = np.where(all_code[at] == code, all_many[at], 0) if len(all_code) else np.zeros(len(code), np.int64)
    x, y = code // len(units), code % len(units)
    together = evidence(many, in_clean, len(toxic), len(clean))
    chosen = (together > PAIR_EVIDENCE) & (together > 1.2 * np.maximum(proof[x], proof[y]))
    couples = {f"{units[a]} {units[b]}": int(n) for a, b, n in zip(x[chosen].tolist(), y[chosen].tolist(), many[chosen].tolist())}
    if proof.max() <= 0 and not couples:
        return None
    sure = proof > (EVIDENCE if couples else min(EVIDENCE, 0.7 * proof.max()))  # of few texts, what stands out
    open_ = (t > 0) & (sure | (c == 0))  # what may be a witness: units of clean texts only on evidence
    negative = np.flatnonzero((c > 0) & ~sure)
    if not len(negative):
        return None
    coupled = set(code[chosen].tolist())
    told = {k: bool(sure[bags.own[k]].any()) or (bool(coupled) and bool(coupled & set(bags.pairs([k])[0].tolist()))) for k in toxic}
    rng = np.random.default_rng(seed)
    pool = rng.permutation(negative)[:background]
    scored = np.flatnonzero((t > 0) | (c > 0))  # units of three letters or more
    names = [units[k] for k in scored]
    clean_texts = [texts[k] for k in clean]
    score, model, worst, near = np.where(sure, proof, -np.inf), None, np.zeros(0, np.int64), []
    for r in range(rounds):
        witness = np.zeros(len(units))
        for k in toxic:
            own = bags.own[k][open_[bags.own[k]]]
            if len(own):
                best = own[np.lexsort((own, score[own]))[-1]]
                if r:  # where a unit of enough evidence explains the label, others must be well inside
                    take = own[(score[own] > (1.0 if told[k] else 0.3)) | sure[own]]
                    if score[best] > 0 and not told[k] and best not in take:
                        witness[best] += 1
                else:
                    take = own[score[own] >= 0.5 * score[best]]
                witness[take[np.isfinite(score[take])]] += 1
        at = np.flatnonzero(witness)
        at = at[np.lexsort((at, -witness[at]))]
        pos, weight = [units[k] for k in at] + list(couples), np.r_[witness[at], list(couples.values())]
        if not pos:
            break
        taken = set(pos)
        neg = sorted({units[k] for k in pool} | {units[k] for k in worst} | (set(near) - taken))
        doubted = np.flatnonzero(sure & (c > 0))  # in clean texts too: against them speaks their share of those
        z = pos[: landmarks // 2]
        z += [units[k] for k in worst[: landmarks - len(z)]]
        z += [neg[int(k)] for k in rng.permutation(len(neg))[: landmarks - len(z)]]
        z = list(dict.fromkeys(z))
        grams, own = Grams.of(z)
        marks = np.zeros((int(grams.third.max(initial=0)) + 1, len(z)), np.float32)
        for j, (ids, w) in enumerate(own):
            marks[ids, j] = w / np.sqrt((w**2).sum())
        values, vectors = np.linalg.eigh(_kernel(z, grams, marks).astype(np.float64))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        # Virtual examples: each witness again with a strange character put in, so that the machine learns to see through it.
        bent = [u[:k] + "abcdefghijklmnopqrstuvwxyz"[i] + u[k:] for u in pos for k, i in zip(rng.integers(1, len(u), 2), rng.integers(0, 26, 2))]
        x = _kernel(pos + bent + neg + [units[k] for k in doubted], grams, marks) @ white
        y = np.r_[np.ones(len(pos) + len(bent)), -np.ones(len(neg) + len(doubted))]
        cost = np.r_[np.r_[weight, np.repeat(weight / 2, 2)] / (2 * weight.sum()) * 1000, np.ones(len(neg)), c[doubted] / len(clean) * 1000]
        w = _svm(x, y, cost, RIDGE)
        model = Model(grams, (marks @ (white @ w[:-1])).astype(np.float32)[grams.third], float(w[-1]), -9.0, pairs=bool(couples))
        score = np.full(len(units), -np.inf)
        score[scored] = model.score(names)
        worst = negative[np.lexsort((negative, -score[negative]))][:hard]
        if r < rounds - 1:  # joins in clean texts are negatives as well: all that come near the witnesses
            mine = {units[k] for k in np.flatnonzero(open_)} | set(couples)
            near = sorted({u for pairs in {False, model.pairs} for x in _joined(clean_texts, model, pairs, -0.5) for u in x if u not in mine} | set(near))
    return model


def _judge(texts: list[str], bags: Bags, chosen: list[int], model: Model) -> np.ndarray:
    """Scores of the chosen texts by their words and pairs."""
    seen = np.unique(np.concatenate([bags.own[k] for k in chosen]))
    score = np.zeros(len(bags.units))
    score[seen] = model.score([bags.units[k] for k in seen])
    own = np.array([score[bags.own[k]].max() for k in chosen])
    return np.maximum(own, [max(x.values(), default=-np.inf) for x in _joined([texts[k] for k in chosen], model, True)]) if model.pairs else own


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, background: int = BACKGROUND, hard: int = HARD, rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """Fit on labelled texts. None if a class is missing.

    Positives are the witnesses of toxic texts: at first units of enough evidence, then, as the machine sees them, the highest unit of each text and all well above the boundary. Negatives are
    ``background`` units drawn from clean texts, the ``hard`` ones among them that score highest, and the joins of clean texts that come near; every witness takes part.
    Every third text is spared for setting the threshold, where each class has ``FEW`` or more.
    """
    texts = [x or "" for x in texts]
    bags, options = Bags(texts), (landmarks, background, hard, rounds, seed)
    toxic, clean = ([k for k, y in enumerate(labels) if bool(y) == want and len(bags.own[k])] for want in (True, False))
    if not toxic or not clean:
        return None
    toxic, clean = bags.distinct(toxic), bags.distinct(clean)
    spare = [[k for i, k in enumerate(ks) if i % 3 == 2] if min(len(toxic), len(clean)) >= FEW else [] for ks in (toxic, clean)]
    model = _machine(texts, bags, *([k for k in ks if k not in set(out)] for ks, out in zip((toxic, clean), spare)), *options)
    if model is None:
        return None
    own = [_judge(texts, bags, ks, model) for ks in (toxic, clean)]
    model.threshold = _threshold(*((_judge(texts, bags, ks, model) for ks in spare) if spare[0] else own))
    clean_texts = [texts[k] for k in clean]
    # Joins are many, and some in clean texts look like a witness by chance: of clean texts that aren't rejected for a word, all but one in JOINS_WRONGLY must stay below.
    rest = [x for x, v in zip(clean_texts, own[1]) if v < model.threshold]
    top = sorted((max(x.values(), default=-np.inf) for x in _joined(rest, model, False)), reverse=True)
    model.margin = float(max(0.0, top[len(top) // JOINS_WRONGLY] - model.threshold + 1e-3)) if top else 0.0
    return model


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on labelled documents, about ``max_toxic`` and ``max_clean`` of them and no more than about ``max_chars`` characters, chosen by a hash.

    The sample is bounded, so its ids are broadcast and the texts are not shuffled. Labels with a null doc_id or a null label are left out; a document with contradictory labels counts as toxic;
    rows that share a doc_id have its label, equal rows count once. Null texts are left out.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(own.groupBy(F.col("toxic") > 0).count().collect())
    part = lambda y, most: (F.col("toxic") > 0 if y else F.col("toxic") <= 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, most / max(1, n.get(y, 0)))))
    chosen = own.where(part(True, max_toxic) | part(False, max_clean)).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("__y"))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")
    rows = cut(rows.dropDuplicates(["doc_id", "text"]), "labelled")
    size = rows.groupBy("__y").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    chars, keep = sum(r["chars"] for r in size), F.lit(False)
    for r in size:
        share = min(1.0, (max_toxic if r["__y"] else max_clean) * 1.2 / r["n"], max_chars / max(1, chars))
        keep = keep | ((F.col("__y") == r["__y"]) & (F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)))
    rows = rows.where(keep).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, y = rows.column("text").to_pylist(), [int(x) for x in rows.column("__y").to_pylist()]
    del rows
    return train(texts, y)


class Scorer:
    """Scores texts, remembering which raw tokens it has seen and the scores of those above the floor; they are few."""

    def __init__(self, model: Model):
        self.model, self.floor = model, model.floor
        self.forget()

    def forget(self) -> None:
        self.seen: set[str] = set()
        self.short: set[str] = set()  # tokens without a unit of three letters
        self.brief: set[str] = set()  # tokens of one to BRIEF letters
        self.hot: dict[str, float] = {}
        self.hot_tokens: set[str] = set()

    def learn(self, new: set[str]) -> None:
        by: dict[str, list[str]] = defaultdict(list)
        for t in new:
            if t.isalpha() and len(t) >= 3:  # most are: their own unit, and not loose
                by[t].append(t)
                if len(t) <= BRIEF:
                    self.brief.add(t)
                continue
            u = unit(t)
            if len(u) >= 3:
                by[u].append(t)
            else:
                self.short.add(t)
            if 0 < len(u) <= BRIEF:
                self.brief.add(t)
        own = list(by)
        got = self.model.score(own)
        for k in np.flatnonzero(got > self.floor).tolist():
            for t in by[own[k]]:
                self.hot[t] = float(got[k])
                self.hot_tokens.add(t)
        self.seen |= new

    def couples(self, texts: list[str]) -> list[list[float]]:
        """Scores of each text's pairs above the floor."""
        if not self.model.pairs:
            return [[]] * len(texts)
        sets = [set(pairs_of(x)) for x in texts]
        units = sorted(set().union(*sets))
        high = {u: v for u, v in zip(units, self.model.score(units).tolist()) if v > self.floor}
        return [[high[u] for u in x if u in high] for x in sets]

    def texts(self, texts: list[str]) -> list[float]:
        low = [x.lower() for x in texts]
        lists = [x.split() for x in low]
        sets = [set(x) for x in lists]
        new = set().union(*sets)
        if len(self.seen) > CACHE:
            self.forget()
        self.learn(new - self.seen)
        more: set[str] = set()
        pairs: list[set[str]] = []
        for x, own, s in zip(low, lists, sets):
            s.update(runs := spaced(x))
            pairs.append(joins(own, self.brief) - s)
            more.update(runs, pairs[-1])
        if more:
            self.learn(more - self.seen)
        out = []
        for s, p, two in zip(sets, pairs, self.couples(texts)):
            hot = [self.hot[t] for t in s & self.hot_tokens] + [self.hot[t] - self.model.margin for t in p & self.hot_tokens] + two
            out.append(max(*hot, self.floor) if hot else -np.inf if s <= self.short and p <= self.short else self.floor)
        return out


_SCORERS: dict[bytes, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The scorer of this model in this Python process, which outlives a task."""
    key = model.digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, toxic, n_toxic_sentences) for every row of docs.

    ``score`` is the margin above the threshold, rounded to 4 places and not below -``FLOOR``; null for null or empty texts, texts without a unit of
    three letters, and where no model could be trained (no labels of one class): such rows are not toxic. Very long texts and words are read whole. Repeated rows and ties
    are scored alike; null ids pass; other columns are ignored, whatever their names; an empty table gives no row.
    """
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"), F.lit(0).alias("n_toxic_sentences"))
    ready(docs.sparkSession)

    def run(batches):
        own = scorer(model)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            raw = []
            for lo in range(0, len(texts), 200):
                raw += own.texts(texts[lo : lo + 200])
            margin = [x - model.threshold for x in raw]
            many = [sum(x >= model.threshold for x in own.texts([s for s in SENTENCE.split(t) if s])) or 1 if m >= 0 else 0 for t, m in zip(texts, margin)]
            yield pa.record_batch([b.column(0), pa.array([round(m, 4) if np.isfinite(m) else None for m in margin], pa.float64()), pa.array([m >= 0 for m in margin]), pa.array(many, pa.int32())], names=["doc_id", "score", "toxic", "n_toxic_sentences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, toxic boolean, n_toxic_sentences int")


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the toxic rows, all columns kept, whatever their names. One pass, no shuffle.

    Rows that can't be scored (null and empty texts, no word of three letters, no model) stay, as do rows without doc_id that aren't toxic; of repeated rows all stay or all go. Very long texts are read whole; an empty table stays empty.
    """
    if model is None:
        return docs
    ready(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        own = scorer(model)
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            keep = []
            for lo in range(0, len(texts), 200):
                keep += [x < model.threshold for x in own.texts(texts[lo : lo + 200])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
