"""Abusive, hateful and sexual content: a character n-gram linear classifier on naive Bayes log-count ratios.

A document is scored by its worst passage: a sentence, a clause of it or two clauses in a row. Texts are folded first
(look-alike letters, figures for letters, spaced or repeated letters, invisible characters), then every character n-gram
is hashed into a fixed table; its weight is the log-count ratio of the n-gram in harmful and harmless text, scaled by a
regularised logistic regression.

All the model knows comes from the labels. They speak of documents, so training looks for the passage that explains each
harmful label: first by the n-grams that harmful documents have and harmless ones have not, then, round by round, by the
model of the passages found before. Labels that no passage explains are set aside, and so are harmless labels that a
passage contradicts. Training uses at most `TRAIN_DOCUMENTS` documents of each label, those with the smallest hashes of
their id; scores, findings and rates cover all documents.

Scale: the weights are three tables of `SIZE` floats, broadcast; a batch of texts is folded and hashed as one string, and
every passage's sum is a difference of two running sums, so a text is gone over once however many passages it has.
Scoring runs inside the scan's partitions, without a shuffle; rates are combined before their shuffle of one row per
source and task.

Defined results: null and blank texts score 0 in every kind; null labels and labels of unknown documents teach nothing;
contradicting labels of a document teach nothing; a kind without a labelled document scores 0 everywhere; a null source
has a row of its own in the rates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.tables import spread

KINDS = ("abusive", "hateful", "sexual")
SIZE, GRAMS = 1 << 20, (3, 4, 5)
#: Half the length of the windows that very long passages are read in.
WINDOW = 150
#: Added to every count.
SMOOTHING = 0.1
#: The least log-count ratio, over the root of the n-grams' number, of a passage that explains a label.
WITNESS = 6.0
#: The least share of its n-grams that no second harmless text has, and for a passage like no other of its label that none has.
NEW, ALONE = 0.05, 0.2
#: So many harmless passages that look worst are learned against, besides the worst one of every harmless text.
HARD = 2000
TRAIN_DOCUMENTS = 2000
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, and figures and marks that stand for letters.
_ALIKE = "асеорхуіїјѕԁһкмтвнгαεορνικτυχβηѵ"
_LOOKALIKE = str.maketrans(_ALIKE, "aceopxyiijsdhkmtbhraeopviktuxbhv")
_FIGURES = str.maketrans("013457@$!|8€", "oieastasiibe")
_LETTER = r"[^\W\d_]"
_FOREIGN = re.compile(f"[{_ALIKE}]+")
_MIXED = re.compile(rf"[0-9@$!|€]{_LETTER}|{_LETTER}[0-9@$!|€]")
_CODE = re.compile(r"^(?:[a-z]{1,4}\d+|\d+[a-z]{1,3}|[a-z]\d[a-z]\d?|q\d|\d+(?:st|nd|rd|th|er))$")
_SPACED = re.compile(rf"(?<!{_LETTER})(?:{_LETTER}[ .\-_*·]){{3,}}{_LETTER}(?!{_LETTER})")
_MAYBE_SPACED = re.compile(rf"[ .\-_*·]{_LETTER}[ .\-_*·]{_LETTER}[ .\-_*·]")
_TAGS = re.compile(r"(?:</?\w{1,6}[^<>\0]{0,40}>)+")
_LAST = 0x10000  # code points from here on are blanks
_TEXT_END, _SENTENCE_END, _CLAUSE_END, _ZERO, _BLANK = 0, 10, 1, 48, 32
_KIND = np.array([unicodedata.category(chr(c)) for c in range(_LAST)])
# Marks that are not seen or stand over letters, and pictures; those beyond the table by their ranges.
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in np.flatnonzero(np.isin(_KIND, ("Cf", "So", "Sk", "Mn")))) + "]+")
_PICTURES = re.compile("[\U0001f000-\U0001ffff\U000e0000-\U000e0fff]+")
#: What each code point is read as: letters, marks of ends and * as themselves, digits as 0, everything else as a blank.
_READ = np.where(np.isin(_KIND, ("Ll", "Lu", "Lt", "Lm", "Lo", "Nl", "No", "Mc")), np.arange(_LAST), np.where(_KIND == "Nd", _ZERO, _BLANK)).astype(np.uint32)
for _c in (_TEXT_END, _SENTENCE_END, ord("*"), ord("_")):
    _READ[_c] = _c
_ENDS, _CLOSERS, _SPACES = (np.isin(np.arange(_LAST), list(map(ord, x))) for x in (".!?…。;:", "\"')]»”", " \t\r\x0b\x0c\xa0"))


def _near(s: str, hint: re.Pattern, inside, change) -> str:
    """`change` of every longest stretch of characters `inside` around a place the hint finds; the rest is as it was."""
    out, at = [], 0
    for m in hint.finditer(s):
        a, b = m.span()
        if a < at:
            continue
        while a > at and inside(s[a - 1]):
            a -= 1
        while b < len(s) and inside(s[b]):
            b += 1
        out += (s[at:a], change(s[a:b]))
        at = b
    return "".join((*out, s[at:])) if at else s


def _latin(word: str) -> str:
    """A word in Latin letters if it has some already, or if all its letters look like Latin ones."""
    seen = word.translate(_LOOKALIKE)
    return seen if word != seen and (seen.isascii() or any("a" <= c <= "z" for c in word)) else word


def _unmask(word: str) -> str:
    w = word.rstrip("!")
    if _CODE.match(w) or sum(c.isdigit() for c in w) > sum(c.isalpha() for c in w) + 1:
        return word
    return w.translate(_FIGURES) + word[len(w) :]


def _joined(line: str) -> str:
    return _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), line)


def unmasked(text: str) -> str:
    """A text without its disguises: lower case, Latin letters for look-alikes and figures, spaced words joined."""
    s = unicodedata.normalize("NFKD", text).lower()
    if not s.isascii():
        s = _near(_INVISIBLE.sub("", _PICTURES.sub("", s)), _FOREIGN, lambda c: c.isalnum() or c == "_", _latin)
    s = _near(s, _MAYBE_SPACED, lambda c: c not in "\n\0", _joined)
    return _near(s, _MIXED, lambda c: c.isalnum() or c in "_@$!|€*", _unmask)


def _codes(s: str) -> np.ndarray:
    """The code points as read, with marks of ends in blanks; blanks and digits once, three letters in a row once."""
    raw = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    raw = np.where(raw < _LAST, raw, _BLANK)
    code = _READ[raw]
    # A blank after a mark of an end, with closing quotes or brackets between or not, ends a sentence; after a comma a clause.
    solid = np.maximum.accumulate(np.where(_CLOSERS[raw], 0, np.arange(len(raw)))) if len(raw) else raw
    before = np.concatenate(([_BLANK], raw[solid][:-1])) if len(raw) else raw
    space = _SPACES[raw]
    code[space & _ENDS[before]] = _SENTENCE_END
    code[space & (np.concatenate(([_BLANK], raw[:-1])) == ord(","))] = _CLAUSE_END
    # Of the blanks and marks in a row the strongest mark stays, as one; a row of digits is one, and so is a row of letters.
    gap = (code == _BLANK) | (code == _SENTENCE_END) | (code == _CLAUSE_END) | (code == _TEXT_END)
    strength = np.where(code == _TEXT_END, 4, np.where(code == _SENTENCE_END, 3, np.where(code == _CLAUSE_END, 2, 1)))
    head = np.flatnonzero((gap != np.concatenate(([~gap[0]], gap[:-1]))) | (~gap & (code != np.concatenate(([0], code[:-1])))) | (code == _TEXT_END)) if len(code) else gap
    size = np.diff(np.concatenate((head, [len(code)])))
    first, kind = code[head], gap[head]
    best = np.maximum.reduceat(strength, head) if len(head) else head
    mark = np.array([0, _BLANK, _CLAUSE_END, _SENTENCE_END, _TEXT_END], np.uint32)[best]
    first = np.where(kind, mark, first)
    times = np.where(kind | (first == _ZERO) | ((size > 2) & (first >= 97)), 1, size)
    # Ends of sentences and texts stand between blanks of their own, so that n-grams know where a passage begins and ends.
    wide = kind & (best > 2)
    out = np.repeat(first, np.where(wide, 3, times))
    at = np.concatenate(([0], np.cumsum(np.where(wide, 3, times))[:-1]))[wide] if len(first) else first
    out[at], out[at + 2], out[at + 1] = _BLANK, _BLANK, first[wide]
    return out


@dataclass(frozen=True)
class Passages:
    """The folded texts of a batch as one row of codes, and where their passages begin and end."""

    code: np.ndarray  # code points; clause ends are blanks
    begin: np.ndarray  # of every passage
    end: np.ndarray
    text: np.ndarray  # the number of the text that the passage is from
    n_texts: int

    def told(self, i: int) -> str:
        return self.code[self.begin[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace").strip()


def passages(texts: list[str | None]) -> Passages:
    """Sentences, clauses of more than 20 characters and pairs of neighbouring clauses of every text."""
    raw = "".join((t or "").replace("\0", " ") + "\0" for t in texts)
    code = _codes(" " + unmasked(_TAGS.sub("\n", raw)))
    last, clause = code == _TEXT_END, code == _CLAUSE_END
    stops = np.flatnonzero((code == _SENTENCE_END) | last | clause)
    begin = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    # A clause ends at its mark, which counts as the blank behind it and before the next one.
    inner = clause[stops]
    end = np.where(inner, stops + 1, stops)
    begin = begin - np.concatenate(([False], inner[:-1])) if len(stops) else begin
    text = np.cumsum(last)[stops] - last[stops]
    code[clause] = _BLANK
    sentence = np.concatenate(([0], np.cumsum(~inner)[:-1])) if len(stops) else stops
    heads = np.flatnonzero(np.diff(sentence, prepend=-1))
    tails = np.concatenate((heads[1:], [len(stops)])) - 1 if len(stops) else heads
    whole = (begin[heads], end[tails], text[heads])
    many = np.repeat(tails > heads, tails - heads + 1) if len(stops) else np.zeros(0, bool)
    long = np.flatnonzero(many & (end - begin > 22))
    two = np.flatnonzero(sentence[:-1] == sentence[1:])
    two = two[np.repeat(tails - heads > 1, tails - heads)] if len(two) else two  # two clauses alone are the sentence
    b, e, t = (np.concatenate(x) for x in zip(whole, (begin[long], end[long], text[long]), (begin[two], end[two + 1], text[two])))
    # A passage that goes on and on without a mark is read in overlapping windows, too.
    wide = np.flatnonzero(e - b > 2 * WINDOW)
    if len(wide):
        count = (e[wide] - b[wide] - 1) // WINDOW
        first = np.repeat(b[wide], count) + WINDOW * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        b, e, t = np.concatenate((b, first)), np.concatenate((e, np.minimum(first + 2 * WINDOW, np.repeat(e[wide], count)))), np.concatenate((t, np.repeat(t[wide], count)))
    keep = e - b > 4
    return Passages(code, b[keep].astype(np.int64), e[keep].astype(np.int64), t[keep].astype(np.int64), len(texts))


def hashes(code: np.ndarray) -> list[np.ndarray]:
    """The hash of the n-gram that begins at each place, one array for each length of GRAMS."""
    out, wide = [], code.astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = max(0, len(code) - n + 1)
        h = (h[:m] * np.uint64(0x9E3779B1) + wide[n - 1 :]) & np.uint64(0xFFFFFFFF)
        if n in GRAMS:
            x = h ^ (h >> np.uint64(15))
            out.append((((x * np.uint64(0x85EBCA6B) + np.uint64(n)) >> np.uint64(7)) & np.uint64(SIZE - 1)).astype(np.int32))
    return out


def _number(p: Passages) -> np.ndarray:
    """How many n-grams every passage has."""
    return sum(np.maximum(0, p.end - p.begin - n + 1) for n in GRAMS)


def _norm(number: np.ndarray) -> np.ndarray:
    """The root of the number; of many n-grams rather their mean counts, so that a small excess of each doesn't add up."""
    return np.maximum(np.sqrt(number), number / np.sqrt(6 * WINDOW))


def _sums(p: Passages, h: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """The sum of `values` (a row of SIZE numbers) over each passage's n-grams."""
    total = np.zeros(len(p.begin))
    for n, own in zip(GRAMS, h):
        run = np.zeros(len(own) + 1)
        np.cumsum(values[own], out=run[1:])
        total += run[np.minimum(np.maximum(p.end - n + 1, p.begin), len(own))] - run[np.minimum(p.begin, len(own))]
    return total


def _grams(p: Passages, h: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number in `which`) of all n-grams of some passages."""
    out, owner = [], []
    for n, own in zip(GRAMS, h):
        size = np.maximum(0, p.end[which] - p.begin[which] - n + 1)
        first = np.repeat(p.begin[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(which) else np.zeros(0, np.int64)
        out.append(own[first + np.arange(int(size.sum()))])
        owner.append(np.repeat(np.arange(len(which)), size))
    return np.concatenate(out), np.concatenate(owner)


class Model:
    """weights: kinds x SIZE, bias: one per kind; a passage's margin is the sum of its n-grams' weights over the root of
    their number, and the bias. A kind that nothing was learned of has no bias."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def margins(self, p: Passages, h: list[np.ndarray]) -> np.ndarray:
        norm = _norm(np.maximum(1, _number(p)))
        return np.stack([np.full(len(norm), -30.0) if np.isnan(b) else _sums(p, h, w) / norm + b for w, b in zip(self.weights, self.bias)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of the worst passage of each text, texts x kinds."""
        p = passages(texts)
        out = np.zeros((p.n_texts, len(KINDS)))
        if len(p.begin):
            margin = self.margins(p, hashes(p.code))
            order = np.argsort(p.text, kind="stable")
            heads = np.flatnonzero(np.diff(p.text[order], prepend=-1))
            out[p.text[order][heads]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(margin[:, order], heads, axis=1).T, -30, 30)))
        return out


def _ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log-count ratios of n-grams in harmful (p) and harmless (q) text."""
    blank = SMOOTHING * np.count_nonzero(p + q)
    ratio = np.log((p + SMOOTHING) / (p.sum() + blank)) - np.log((q + SMOOTHING) / (q.sum() + blank))
    # The classes differ in size, so smoothing alone would speak for the smaller one: what it never had says nothing for it.
    return np.where(p == 0, np.minimum(ratio, 0.0), ratio)


def _fit(ratio: np.ndarray, h: np.ndarray, o: np.ndarray, y: np.ndarray, steps: int = 50, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias): the ratios scaled by logistic regression (Adam), each n-gram by a factor of its own near 1."""
    norm = _norm(np.maximum(1, np.bincount(o, minlength=len(y))))
    used, h = np.unique(h, return_inverse=True)
    x = ratio[used][h] / norm[o]
    plain = np.bincount(o, weights=x, minlength=len(y))
    # The ratios as a whole come to the range in which the logistic curve bends.
    high, low = np.median(plain[y]), np.percentile(plain[~y], 90) if (~y).any() else 0.0
    scale = 8 / max(1.0, high - low)
    x = x * scale
    v, bias = np.ones(len(used)), -(high + low) / 2 * scale
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        margin = np.bincount(o, weights=x * v[h], minlength=len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / max(1, y.sum())
        g = np.concatenate((np.bincount(h, weights=x * err[o], minlength=len(used)) + decay * (v - 1), [err.sum()]))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        v, bias = v - move[:-1], bias - move[-1]
    weights = ratio * scale
    weights[used] *= v
    return weights, float(bias)


def _texts_with(p: Passages, h: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
    """In how many of the texts each n-gram is."""
    of = np.concatenate(([0], np.cumsum(p.code == 0)))
    out = np.zeros(SIZE)
    for own in h:
        here = np.flatnonzero(texts[np.minimum(of[: len(own)], p.n_texts - 1)])
        pairs = np.unique(of[here].astype(np.int64) * SIZE + own[here])
        out += np.bincount(pairs % SIZE, minlength=SIZE)
    return out


def train(labelled: list[tuple[str | None, str]], rounds: int = 4) -> Model:
    """From (text, label) of labelled documents.

    The passage of a harmful text that explains its label is looked for by log-count ratios alone, without the text's own
    n-grams, so that a passage must share what makes it harmful with other texts of the label. A wrongly labelled text
    has no such passage. The passages found are then told from harmless ones by the scaled ratios.
    """
    docs = [(t, (*KINDS, "none").index(label)) for t, label in labelled if t and label in (*KINDS, "none")]
    p, label = passages([t for t, _ in docs]), np.array([k for _, k in docs], int)
    weights, bias = np.zeros((len(KINDS), SIZE)), np.full(len(KINDS), np.nan)
    kinds = [k for k in range(len(KINDS)) if len(p.begin) and (label[p.text] == k).any()]
    if not kinds:
        return Model(weights.astype(np.float32), bias)
    h, of = hashes(p.code), label[p.text]
    number = np.maximum(1, _number(p))
    norm = _norm(number)
    place = np.minimum(np.concatenate(([0], np.cumsum(p.code == _TEXT_END))), p.n_texts - 1)
    order = np.argsort(p.text, kind="stable")
    heads = np.flatnonzero(np.diff(p.text[order], prepend=-1))
    none = len(KINDS)

    def best(score: np.ndarray) -> np.ndarray:
        """The first passage of each text with the text's highest score."""
        top = np.repeat(np.maximum.reduceat(score[order], heads), np.diff(np.concatenate((heads, [len(order)]))))
        first = np.flatnonzero(score[order] == top)
        return order[first[np.unique(p.text[order][first], return_index=True)[1]]]

    def ratios(mine: np.ndarray, theirs: np.ndarray, k: int) -> np.ndarray:
        """The margins by ratios alone; a text's own n-grams are left out of the counts that it speaks for."""
        score = _sums(p, h, _ratio(mine, theirs))
        for c, a, b in ((k, np.maximum(mine - 1, 0), theirs), (none, mine, np.maximum(theirs - 1, 0))):
            score = np.where(of == c, _sums(p, h, _ratio(a, b)), score)
        return score / norm

    told: dict[int, np.ndarray] = {}
    score = np.full((len(KINDS), len(of)), -30.0)
    calm = label == none
    for step in range(rounds):
        if step:
            theirs = sum(np.bincount(own[calm[place[: len(own)]]], minlength=SIZE) for own in h).astype(float)
        else:
            theirs = _texts_with(p, h, calm)
        unseen, rare = _sums(p, h, (theirs == 0).astype(float)) / number, _sums(p, h, (theirs <= 1).astype(float)) / number
        for k in kinds:
            mine = np.bincount(_grams(p, h, told[k])[0], minlength=SIZE).astype(float) if step else _texts_with(p, h, label == k)
            score[k] = ratios(mine, theirs, k)
        for k in kinds:
            x = best(score[k])
            x = x[of[x] == k]
            told[k] = x[(score[k, x] > (WITNESS if step else 0)) & (score[:, x].argmax(axis=0) == k) & (rare[x] >= NEW)]
            if step and len(told[k]):
                # Harmless texts with a passage as clear as half of those found, and unlike other harmless texts, are labelled wrongly.
                x = best(score[k])
                calm[p.text[x[(of[x] == none) & (score[k, x] >= np.median(score[k, told[k]])) & (rare[x] >= NEW)]]] = False
        if step == rounds - 1:
            # What no other text of the label has explains a label, too, if harmless texts have nothing like it.
            x = best(np.where(number >= 30, unseen, 0.0))
            for k in kinds:
                lone = x[(of[x] == k) & (unseen[x] >= ALONE) & (score[:, x].max(axis=0) <= WITNESS)]
                told[k] = np.union1d(told[k], lone[~np.isin(p.text[lone], p.text[told[k]])])
    for k in kinds:
        if not len(told[k]):
            continue
        x = best(score[k])
        quiet = np.flatnonzero(calm[p.text])
        loud = quiet[np.argsort(-score[k, quiet], kind="stable")[:HARD]]
        negative = np.setdiff1d(np.concatenate([x[calm[p.text[x]]], loud, *(told[j] for j in kinds if j != k)]), told[k])
        which = np.concatenate([told[k], negative])
        g, o = _grams(p, h, which)
        mine = np.bincount(_grams(p, h, told[k])[0], minlength=SIZE).astype(float)
        others = sum((np.bincount(_grams(p, h, told[j])[0], minlength=SIZE) for j in kinds if j != k), np.zeros(SIZE))
        weights[k], bias[k] = _fit(_ratio(mine, theirs + others), g, o, np.arange(len(which)) < len(told[k]))
    return Model(weights.astype(np.float32), bias)


def train_on(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Model:
    """The model of a labelled sample: at most `most` documents of each label come to the driver."""
    told = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    parts = [told.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (*KINDS, "none")]
    sample = reduce(DataFrame.unionByName, parts)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("text", "label").toPandas()
    return train(list(rows.itertuples(index=False, name=None)))


def score_documents(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): the score of every document's worst passage in each kind."""
    return score_by(documents, train_on(documents, labels, most))


def score_by(documents: DataFrame, model: Model) -> DataFrame:
    """The scores by a model that is there already."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in batches:
            for a in range(0, len(whole), 500):
                df = whole.iloc[a : a + 500]
                best = m.score(df["text"].tolist()).round(6)
                yield pd.DataFrame({"doc_id": df["doc_id"].to_numpy(), "source": df["source"].to_numpy(), **{k: best[:, j] for j, k in enumerate(KINDS)}})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, abusive double, hateful double, sexual double")


def found(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, harm): one row per document and kind."""
    kinds = F.array_compact(F.array(*[F.when(F.col(k) >= threshold, F.lit(k)) for k in KINDS]))
    return scores.select("doc_id", F.explode(kinds).alias("harm")).distinct()


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, abusive_rate, hateful_rate, sexual_rate) of every source."""
    share = lambda k: F.round(F.avg((F.col(k) >= threshold).cast("double")), 6).alias(f"{k}_rate")
    return scores.groupBy("source").agg(F.count("*").alias("n_documents"), *[share(k) for k in KINDS])
