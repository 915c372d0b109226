"""Broken prompt and response pairs.

An answer is cut into clauses; a linear-chain conditional random field tags each clause as answer, refusal, echo,
foreign or unfinished; the share of the answer that each tag covers decides on the pair's defect.

The field's labels don't come from its features. Clauses of answers that cite a source are answers; the abstentions that
verdicts name are refusals; and from good answers broken ones are made: cut at any place, replaced by the question in
various forms, or moved to a question in another language. The features are measures: how much a clause and its question
share, which language both are in, how a clause ends and how often its last word ends clauses elsewhere, and how many of
its words the corpus knows from answers without source and figure, but hardly from those with one. No wording of
refusals is written down: what refusals say is what supported answers don't.

Training uses at most `TRAIN_TURNS` turns, those with the smallest hashes of their text, and as many abstentions; the
word statistics are those of all turns, in a table of fixed size, and everything else covers all turns, too.

Defined results: a null, empty or blank answer, or one of marks, citation markers or a placeholder only, is `empty`
whatever the question; a null question can't be copied and has no language; a missing verdict changes nothing; repeats
of a turn count once; turns without defect have no row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TRAIN_TURNS, TRAIN_ABSTENTIONS = 3000, 200
#: Words are counted in a table of this size by their hash.
BUCKETS = 1 << 17
#: How much more often, as a log ratio, a word comes in answers without support to count as unlike the others.
UNLIKE = 1.8

# Function words by language.
_FUNCTION_WORDS = {
    "en": "the of and to in is was were are for that with on by from has have had which this these not be been it its as at or an a but than their there i you your we can cannot will would could did does do what how why about please more so no any my me rather if",
    "de": "der die das und ist sind war waren für mit von im in den dem des ein eine einer eines nicht auf bei nach aus zum zur wird werden wurde wurden hat haben als auch sich was wie warum welche welcher bitte ich sie es kann keine kein zu um bis über diese dieser dazu deshalb am an durch oder nur",
    "fr": "le la les des du de et est sont était pour dans avec sur par au aux un une ne pas que qui ce cette ces il elle nous vous je à en a été ont plus quels quelle quel pourquoi comment quoi comme ou ne se sa son leur leurs d l s n qu",
    "es": "el la los las del de y es son era para en con por al un una no que qué se su sus lo como más ha han fue cómo cuál cuáles por favor esta este estos estas le nos a o pese sobre entre sin hay según mi me",
}
_LANGS = tuple(_FUNCTION_WORDS)
_WORD_LANGS: dict[str, np.ndarray] = {}
for _i, _words in enumerate(_FUNCTION_WORDS.values()):
    for _w in set(_words.split()):
        _WORD_LANGS.setdefault(_w, np.zeros(len(_LANGS)))[_i] = 1.0
for _v in _WORD_LANGS.values():
    _v /= _v.sum()

# How a question asks for a language, and what stands for no answer.
_ASKS = re.compile(r"(?i)\b(?:in|into|auf|ins?|en|au|to)\s+(english|french|german|spanish|italian|englisch\w*|französisch\w*|deutsch\w*|spanisch\w*|inglés|francés|alemán|español|castellano|anglais|français|allemand|espagnol)\b|\b(?:translat|übersetz|tradu)\w*")
_PLACEHOLDER = re.compile(r"(?i)^(?:null|none|nil|n/?a|nan|tbd|todo|undefined|empty|no answer|keine|leer|vide|vacío|\W|<br\s*/?>|&nbsp;|_)*$")
_MARKER = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_TOKEN = re.compile(r"[^\W_]+|\x01")
_ITEM = re.compile(r"(?:[-*+•]|\d{1,2}[.)])(?:\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+(?=[^\s\[])")
_DIGITS = re.compile(r"\d+")
_EDGE = re.compile(r"\b|(?<=[^\w\s])")
_LINE_EDGE = re.compile(r"(?<=\n[^\s])|(?<=\n[^\s][^\s])|(?<=\n[^\s][^\s][^\n])")
_CLOSERS = "\"'»”’)]*_ "
KINDS = ("prose", "list", "table", "code", "fence")


def is_empty(answer: str | None) -> bool:
    """Whether an answer has no content of its own."""
    if answer is None:
        return True
    if len(answer) > 200:
        return not any(c.isalnum() for c in _MARKER.sub(" ", answer))
    s = re.sub(r"(?i)<[^<>]{1,40}>|```\w*|&nbsp;", " ", _MARKER.sub(" ", answer))
    s = "".join(c for c in s if not unicodedata.category(c).startswith(("C", "Z")))
    return bool(_PLACEHOLDER.match(s)) or not any(c.isalnum() for c in s)


def clauses(answer: str) -> list[tuple[int, str]]:
    """(kind, text) of each clause: prose sentences, list items, table rows and code lines, in order; no citation markers."""
    out, code = [], False
    for line in _MARKER.sub(" ", answer).split("\n"):
        s = line.strip()
        if s.startswith("```"):
            code = not code
            out.append((4, s))
        elif s:
            if code:
                out.append((3, s))
            elif s[0] == "|":
                out.append((2, s))
            elif _ITEM.match(s):
                out.append((1, s))
            else:
                out += [(0, x) for x in _SENTENCE.split(s) if x]
    return out


# ---------------------------------------------------------------- features


@dataclass(frozen=True)
class Words:
    """What the corpus knows of words: logs of how much more often they come without support, and how frequent they are."""

    odds: np.ndarray
    n: np.ndarray  # the share of all words
    final: np.ndarray  # the share of their occurrences that end a clause

    @classmethod
    def of(cls, supported: np.ndarray, other: np.ndarray, final: np.ndarray) -> Words:
        n = supported + other
        # A word that is hardly known speaks for neither side.
        blank = 4 / max(1.0, n.sum())
        odds = np.log(other / max(1.0, other.sum()) + blank) - np.log(supported / max(1.0, supported.sum()) + blank)
        return cls(odds.astype(np.float32), (n / max(1.0, n.sum())).astype(np.float32), (final / np.maximum(n, 1)).astype(np.float32))


#: The features of a clause, one value of each: name and number of values.
FEATURES = (
    ("kind", 5), ("echo", 35), ("echo of the whole", 35), ("language", 3), ("figures", 3), ("unlike words", 5), ("unlike words of the whole", 5), ("their number by length", 12),
    ("end", 73), ("last word", 26), ("broken block", 5), ("function words", 7), ("first", 2),
)
_OFFSET = np.concatenate(([0], np.cumsum([n for _, n in FEATURES])))
N_FEATURES = int(_OFFSET[-1])
_ECHO_A, _ECHO_B = np.array([0.3, 0.5, 0.65, 0.75, 0.85, 0.95]), np.array([0.25, 0.45, 0.6, 0.8])


@dataclass(frozen=True)
class Clauses:
    """The clauses of a batch of turns, in order: each one's turn, size in letters and digits, and features (n x features)."""

    turn: np.ndarray
    size: np.ndarray
    features: np.ndarray


def _tokens(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) numbers of all words of the texts; new words get a number in `index`."""
    joined = unicodedata.normalize("NFKC", "\x01".join(t.replace("\x01", " ") for t in texts)).lower()
    found = np.fromiter((-1 if w == "\x01" else index.setdefault(w, len(index)) for w in _TOKEN.findall(joined)), np.int64)
    return found[found >= 0], np.cumsum(found < 0)[found >= 0]


def _end(text: str) -> int:
    """How a clause ends: 0 stop, 1 mark that goes on or nothing but an item's mark, 2 letter, 3 digit or per cent, 4 pipe, 5 other."""
    if _ITEM.fullmatch(text):
        return 1
    s = text.rstrip(_CLOSERS) or text
    c = s[-1]
    return 0 if c in ".!?…。！？" else 1 if c in ",;:-–—([{/" else 4 if c == "|" else 3 if c.isdigit() or c in "%‰€$£" else 2 if c.isalpha() else 5


def read(questions: list[str | None], answers: list[str], words: Words) -> Clauses:
    """The clauses of turns whose answers aren't empty, with their features."""
    parts = [clauses(a) for a in answers]
    turn = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    texts = [t for p in parts for _, t in p]
    kind = np.fromiter((k for p in parts for k, _ in p), np.int64, len(texts))
    n, n_turns = len(texts), len(parts)
    index: dict[str, int] = {}
    # An item's number is no word of it.
    w, c = _tokens([_ITEM.sub("", t, 1) if k == 1 else t for t, k in zip(texts, kind)], index) if texts else (np.zeros(0, np.int64),) * 2
    qw, qt = _tokens([q or "" for q in questions], index) if n_turns else (np.zeros(0, np.int64),) * 2
    names = list(index)
    bucket = np.fromiter((zlib.crc32(_DIGITS.sub("0", x).encode("utf-8", "replace")) % BUCKETS for x in names), np.int64, len(names))
    figure = np.fromiter((any(map(str.isdigit, x)) for x in names), bool, len(names))
    langs = np.array([_WORD_LANGS.get(x, _NO_LANG) for x in names]).reshape(len(names), len(_LANGS))
    per = lambda at, weights=None, size=n: np.bincount(at, weights=weights, minlength=size)
    count = per(c)
    letters = np.bincount(c, weights=np.fromiter(map(len, names), float, len(names))[w], minlength=n) if len(w) else np.zeros(n)

    # What a clause and the whole answer share with the question.
    asked = np.unique(qt * len(names) + qw)
    asked_n = np.maximum(1, per(asked // max(1, len(names)), size=n_turns))
    own = turn[c] * len(names) + w
    in_q = np.isin(own, asked)
    part = per(c, in_q) / np.maximum(1, count)
    seen = np.unique(c[in_q] * len(names) + w[in_q]) // max(1, len(names))
    of_q = per(seen) / asked_n[turn]
    whole_part = per(turn[c], in_q, n_turns) / np.maximum(1, per(turn[c], size=n_turns))
    whole_of_q = per(np.unique(own[in_q]) // max(1, len(names)), size=n_turns) / asked_n
    longer = per(turn[c], size=n_turns) > 4 * asked_n
    bins = lambda a, b: np.searchsorted(_ECHO_A, a, "right") * 5 + np.searchsorted(_ECHO_B, b, "right")
    echo = np.where((count >= 3) | (of_q >= 0.6), bins(part, of_q), 0)
    echo_whole = np.where(longer, 0, bins(whole_part, whole_of_q))[turn]

    # Languages by function words; what has too few of them is judged by the whole answer.
    score = np.stack([per(c, langs[w, i]) for i in range(len(_LANGS))], axis=1) if len(w) else np.zeros((n, len(_LANGS)))
    text_like = (kind < 2)[:, None]
    whole = np.stack([per(turn, (score * text_like)[:, i], n_turns) for i in range(len(_LANGS))], axis=1)
    ask = np.stack([per(qt, langs[qw, i], n_turns) for i in range(len(_LANGS))], axis=1) if len(qw) else np.zeros((n_turns, len(_LANGS)))
    top = lambda s: (s.argmax(axis=1), (t := np.sort(s, axis=1))[:, -1] - t[:, -2])
    (lang, margin), (whole_lang, whole_margin), (ask_lang, ask_margin) = top(score), top(whole), top(ask)
    by_whole = (margin < 1) | (count < 3) | (kind > 1)
    lang, margin = np.where(by_whole, whole_lang[turn], lang), np.where(by_whole, np.where(count >= 3, whole_margin[turn], 0), margin)
    free = np.fromiter((bool(_ASKS.search(q or "")) for q in questions), bool, n_turns)
    known = (margin >= 1) & (whole_margin[turn] >= 1) & (ask_margin[turn] > 0) & (kind < 2)
    language = np.where(~known, 0, np.where(free[turn] | (lang == ask_lang[turn]), 1, 2))

    figures = np.where(per(c, figure[w] & ~in_q) > 0, 2, np.where(per(c, figure[w]) > 0, 1, 0)) if len(w) else np.zeros(n, int)

    # Words that answers with support hardly have.
    odd = (words.odds[bucket[w]] > UNLIKE) & ~in_q if len(w) else np.zeros(0, bool)
    free_n = count - per(c, in_q)
    odd_n = per(c, odd)
    level = lambda odd_n, free_n, n: np.where(free_n > 0, 1 + np.searchsorted([0.001, 0.12, 0.25], odd_n / np.maximum(1, n), "right"), 0)
    share, share_whole = level(odd_n, free_n, count), level(per(turn, odd_n, n_turns), per(turn, free_n, n_turns), per(turn, count, n_turns))[turn]
    odd_by_length = np.minimum(odd_n, 2).astype(int) * 4 + np.searchsorted([4, 8, 16], count, "right")

    # How the answer ends.
    last = np.concatenate((turn[1:] != turn[:-1], [True])) if n else np.zeros(0, bool)
    end = np.fromiter(map(_end, texts), np.int64, n)
    finished = (kind == 0) & (count > 1) & ((end == 0) | np.fromiter((t[-1] == ";" for t in texts), bool, n)) & (part < 0.85)
    before = (per(turn, finished, n_turns)[turn] - finished) > 0
    fences, pipes = per(turn, kind == 4, n_turns), np.fromiter((t.count("|") for t in texts), np.int64, n)
    widest = np.zeros(n_turns, np.int64)
    np.maximum.at(widest, turn[kind == 2], pipes[kind == 2])
    broken = np.where((fences % 2 == 1)[turn], 1, np.where(kind == 2, np.where((end != 4) | (pipes < widest[turn]), 2, 3), 0))
    final_word = np.full(n, -1)
    final_word[c] = w  # the last assignment stays
    at = bucket[np.maximum(final_word, 0)] if len(names) else np.zeros(n, np.int64)
    number = np.searchsorted([3e-6, 1e-5, 5e-5, 3e-4], words.n[at], "right") * 5 + np.searchsorted([0.005, 0.03, 0.1, 0.4], words.final[at], "right")
    function = per(c, (langs.sum(axis=1) > 0)[w]) if len(w) else np.zeros(n)
    values = np.stack([
        kind, echo, echo_whole, language, figures, share, share_whole, odd_by_length,
        np.where(last, 1 + (kind * 6 + end) * 2 + before, 0), np.where(last & (end != 0) & (final_word >= 0), 1 + number, 0), np.where(last, 1 + broken, 0),
        np.where(last, 1 + np.minimum(function, 2).astype(int) * 2 + before, 0), np.concatenate(([1], (turn[1:] != turn[:-1]).astype(int))) if n else kind,
    ], axis=1)
    return Clauses(turn, np.where(kind == 4, 0, letters), values + _OFFSET[:-1])


_NO_LANG = np.zeros(len(_LANGS))


# ---------------------------------------------------------------- the field


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))


class _Steps:
    """Sequences of a flat table of clauses, longest first: step t has the t-th clause of every sequence that has one."""

    def __init__(self, turn: np.ndarray):
        heads = np.flatnonzero(np.diff(turn, prepend=-1)) if len(turn) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((heads, [len(turn)])))
        order = np.argsort(-size, kind="stable")
        self.turns, self.heads, self.size = turn[heads[order]] if len(turn) else heads, heads[order], size[order]

    def __iter__(self) -> Iterator[np.ndarray]:
        for t in range(int(self.size.max(initial=0))):
            yield self.heads[: np.searchsorted(-self.size, -t, "left")] + t


class Field:
    """A linear-chain conditional random field over the features of FEATURES."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def tags(self, c: Clauses) -> np.ndarray:
        """The most probable tags (Viterbi), for all turns of a batch at once."""
        s = self.weights[c.features].sum(axis=1)
        steps = list(_Steps(c.turn))
        back = []
        for now, before in zip(steps[1:], steps):
            via = s[before[: len(now)], :, None] + self.moves
            back.append(via.argmax(axis=1))
            s[now] += via.max(axis=1)
        out = np.zeros(len(s), np.int64)
        for t in range(len(steps) - 1, -1, -1):
            now = steps[t]
            more = len(steps[t + 1]) if t + 1 < len(steps) else 0
            out[now[more:]] = s[now[more:]].argmax(axis=1)
            if more:
                out[now[:more]] = back[t][np.arange(more), out[steps[t + 1]]]
        return out

    @classmethod
    def train(cls, c: Clauses, gold: np.ndarray, rounds: int = 100, rate: float = 0.2, decay: float = 1e-4) -> Field:
        """Maximum likelihood by forward-backward over all sequences at once, Adam steps."""
        K, n = len(TAGS), max(1, len(np.unique(c.turn)))
        steps = list(_Steps(c.turn))
        flat = c.features.ravel()
        w, m = np.zeros((N_FEATURES, K)), np.zeros((K, K))
        truth = np.zeros((len(gold), K))
        truth[np.arange(len(gold)), gold] = 1
        mom = [np.zeros_like(x) for x in (w, w, m, m)]
        for step in range(1, rounds + 1):
            s = w[c.features].sum(axis=1)
            alpha, beta = s.copy(), np.zeros_like(s)
            for now, before in zip(steps[1:], steps):
                alpha[now] += _lse(alpha[before[: len(now)], :, None] + m, 1)
            for now, before in zip(steps[:0:-1], steps[-2::-1]):
                beta[before[: len(now)]] = _lse(m + (s[now] + beta[now])[:, None, :], 2)
            both = alpha + beta
            z = _lse(both, 1)
            diff = np.exp(both - z[:, None]) - truth
            gm = decay * m
            for now, before in zip(steps[1:], steps):
                b = before[: len(now)]
                gm += (np.exp(alpha[b, :, None] + m + (s[now] + beta[now])[:, None, :] - z[now][:, None, None]).sum(axis=0) - truth[b].T @ truth[now]) / n
            gw = np.stack([np.bincount(flat, weights=np.repeat(diff[:, k], c.features.shape[1]), minlength=N_FEATURES) for k in range(K)], axis=1) / n + decay * w
            for x, g, k in ((w, gw, 0), (m, gm, 2)):
                mom[k] = 0.9 * mom[k] + 0.1 * g
                mom[k + 1] = 0.999 * mom[k + 1] + 0.001 * g * g
                x -= rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(mom[k + 1] / (1 - 0.999**step)) + 1e-8)
        return cls(w, m)


# ---------------------------------------------------------------- labels


def _cut(text: str, rng: np.random.Generator) -> str | None:
    """A text broken off somewhere behind its first fifth: at any character, where a word or mark begins or ends, or soon
    after a line's begin; never where a line or sentence ends. None if it has no such place."""
    text = _MARKER.sub(" ", text).rstrip()
    least = max(1, len(text) // 5)
    draw = rng.random()
    edges = [m.start() for m in (_EDGE if draw > 0.2 else _LINE_EDGE).finditer(text, least)] if draw < 0.7 else list(range(least, len(text)))
    for _ in range(4 if edges else 0):
        at = edges[int(rng.integers(len(edges)))]
        cut = text[:at].rstrip()
        if cut and text[len(cut) :].lstrip(" ")[:1] not in ("", "\n") and _end(cut.rpartition("\n")[2].strip() or cut):
            return cut
    return None


def _complete(answer: str) -> bool:
    """Whether no block is left open: code is closed, the last item isn't empty, the last row of a table is as wide as the others."""
    c = clauses(answer)
    rows = [t.count("|") for k, t in c if k == 2]
    return sum(k == 4 for k, _ in c) % 2 == 0 and not (c[-1][0] == 1 and _ITEM.fullmatch(c[-1][1])) and not (c[-1][0] == 2 and rows[-1] < max(rows))


def _echoed(question: str, strange: str, rng: np.random.Generator) -> str:
    """A question as an answer gives it back: as it is, in other letters, twice, behind some words, or not quite."""
    words = question.split()
    form = int(rng.integers(7))
    if form == 1:
        return question.upper()
    if form == 2:
        return f"**{question.strip()}**"
    if form == 3:
        return f"{question} {question}"
    if form == 4:
        return " ".join(strange.split()[: int(rng.integers(1, 3))]) + ": " + question
    if form == 5 and len(words) > 5:
        return " ".join(x for x in words if rng.random() > 0.12)
    if form == 6 and len(words) > 5:
        i = int(rng.integers(len(words)))
        return " ".join(words[:i] + words[i + 1 :][::-1])
    return question


def _language(text: str) -> int:
    s = sum((_WORD_LANGS.get(w, _NO_LANG) for w in _TOKEN.findall(text.lower())), np.zeros(len(_LANGS)))
    return int(s.argmax()) if s.any() else -1


def labelled(turns: list[tuple[str | None, str]], abstentions: list[str], seed: int = 0) -> tuple[list[str], list[str], list[list[int]]]:
    """(questions, answers, tags by clause) from sampled turns and the abstentions that verdicts name.

    Good answers are those that cite a source, and of those without the ones that are a list, a table or code with no block
    left open, or names only. A part of the other answers with figures of their own counts as good, too: few are not.
    """
    rng = np.random.default_rng(seed)
    questions, answers, tags = [], [], []

    def add(q: str, a: str, body: int, last: int | None = None, head: int = 0) -> None:
        n = len(clauses(a))
        if n and not is_empty(a):
            questions.append(q)
            answers.append(a)
            tags.append([ECHO] * min(head, n - 1) + [body] * (n - 1 - min(head, n - 1)) + [body if last is None else last])

    turns = [(q, a) for q, a in turns if q and a and not is_empty(a)]
    cites = [bool(_MARKER.search(a)) for _, a in turns]
    plain = lambda a: any(k for k, _ in clauses(a)) or not any(w in _WORD_LANGS for w in _TOKEN.findall(a.lower()))
    good = [(q, a) for (q, a), c in zip(turns, cites) if c or (plain(a) and _complete(a))]
    of: dict[int, list[str]] = {}
    langs = [_language(q) for q, _ in turns]
    for (q, a), c, x in zip(turns, cites, langs):
        if c and x >= 0:
            of.setdefault(x, []).append(a)
    for q, a in good:
        # Lists, tables and code are rare, and there are more places where they can break off.
        blocks = any(k for k, _ in clauses(a))
        for _ in range(3 if blocks else 1):
            add(q, a, ANSWER)
        for _ in range(2 if blocks else int(rng.random() < 0.5)):
            if cut := _cut(a, rng):
                add(q, cut, ANSWER, UNFINISHED)
    for (q, a), c, x in zip(turns, cites, langs):
        draw = rng.random()
        # Most answers with figures of their own and an end are good, too, whatever their words.
        if not c and draw > 0.7 and _end(a) == 0 and _language(a) in (-1, x) and set(_DIGITS.findall(a)) - set(_DIGITS.findall(q)):
            add(q, a, ANSWER)
        if draw < 0.2:
            strange = (abstentions or [a])[int(rng.integers(len(abstentions or [a])))] if rng.random() < 0.3 else turns[int(rng.integers(len(turns)))][1]
            add(q, _echoed(q, strange, rng), ECHO)
        elif draw < 0.25 and c:
            add(q, f"{q}\n\n{a}", ANSWER, head=len(clauses(q)))
        elif draw < 0.35 and c:
            # An answer that takes up a part of the question's words.
            start, rest = q.rstrip("?").split(), clauses(a)[-1][1].split()
            add(q, " ".join(start[len(start) // 2 :] + rest[-max(3, len(start) // 2) :]), ANSWER)
        elif draw < 0.55 and x >= 0 and not _ASKS.search(q):
            foreign = [y for y in of if y != x]
            if foreign:
                pool = of[foreign[int(rng.integers(len(foreign)))]]
                add(q, pool[int(rng.integers(len(pool)))], FOREIGN)
    if turns:
        for i, text in enumerate(abstentions * (1 + 300 // max(1, len(abstentions)) if abstentions else 0)):
            q = turns[int(rng.integers(len(turns)))][0]
            add(q, text, REFUSAL)
            if i % 3 == 0 and len(clauses(text)) > 1:
                add(q, clauses(text)[int(rng.integers(len(clauses(text))))][1], REFUSAL)
    return questions, answers, tags


def train_field(turns: list[tuple[str | None, str]], abstentions: list[str], words: Words) -> Field:
    questions, answers, tags = labelled(turns, abstentions)
    if not answers:
        return Field(np.zeros((N_FEATURES, len(TAGS))), np.zeros((len(TAGS), len(TAGS))))
    return Field.train(read(questions, answers, words), np.concatenate(tags))


# ---------------------------------------------------------------- defects


def defects(field: Field, words: Words, questions: list[str | None], answers: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """(defect or None, the share of the answer by tag) of every turn."""
    out: list[str | None] = ["empty"] * len(answers)
    share = np.zeros((len(answers), len(TAGS)))
    full = [i for i, a in enumerate(answers) if not is_empty(a)]
    c = read([questions[i] for i in full], [answers[i] for i in full], words)
    tags = field.tags(c)
    cover = np.zeros((len(full), len(TAGS)))
    np.add.at(cover, (c.turn, tags), c.size)
    cover /= np.maximum(1, cover.sum(axis=1, keepdims=True))
    last = np.full(len(full), ANSWER)
    last[c.turn] = tags  # the last assignment stays
    for j, i in enumerate(full):
        s = cover[j]
        if s[REFUSAL] > 0 and s[REFUSAL] + s[ECHO] >= 0.9:
            out[i] = "refusal"
        elif s[ECHO] >= 0.9 or (s[ECHO] > 0 and s[ECHO] + s[UNFINISHED] >= 0.999 and last[j] == ECHO):
            out[i] = "copy"
        elif last[j] == UNFINISHED:
            out[i] = "truncated"
        elif s[FOREIGN] > 0.5:
            out[i] = "language"
        else:
            out[i] = None
    share[full] = cover
    return out, share


def word_counts(messages: DataFrame) -> Words:
    """The words of all answers by hash: with support (a citation marker or a figure), without, and at the ends of clauses.

    Counted inside the tasks; at most BUCKETS rows, whatever the corpus, come to the driver.
    """
    stops = r".!?…;|\n"
    plain = F.lower(F.regexp_replace("answer", _MARKER.pattern, " "))
    text = F.concat(F.regexp_replace(plain, r"\d+", "0"), F.lit("\n"))  # figures count as one word
    rows = messages.filter("answer IS NOT NULL").select(text.alias("t"), (F.col("answer").rlike(_MARKER.pattern) | plain.rlike(r"\d")).alias("s"))
    tokens = rows.select("s", F.explode(F.split("t", rf"[^\p{{L}}\p{{N}}{stops}]+|(?<=[{stops}])")).alias("token")).groupBy("token", "s").agg(F.count("*").alias("n"))
    word, n = F.rtrim("token", F.lit(".!?…;|\n")), F.col("n")
    named = tokens.select(word.alias("word"), "s", "n", (F.col("token") != word).alias("final")).filter("word <> ''")
    bucket = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(BUCKETS)).cast("int")
    sums = named.groupBy(bucket.alias("b")).agg(F.sum(F.when(F.col("s"), n).otherwise(0)).alias("s"), F.sum(F.when(~F.col("s"), n).otherwise(0)).alias("o"), F.sum(F.when(F.col("final"), n).otherwise(0)).alias("f")).toPandas()
    table = np.zeros((3, BUCKETS))
    table[:, sums["b"].to_numpy(np.int64)] = sums[["s", "o", "f"]].to_numpy(float).T
    return Words.of(*table)


def turns(messages: DataFrame) -> DataFrame:
    """(seq, question, answer): distinct turns."""
    return messages.select("seq", "question", "answer").distinct()


def trained(messages: DataFrame, verdicts: DataFrame, most: int = TRAIN_TURNS) -> tuple[Field, Words]:
    """The field and what is known of words; at most `most` turns and TRAIN_ABSTENTIONS abstentions come to the driver."""
    words = word_counts(messages)
    sample = messages.filter("question IS NOT NULL AND answer IS NOT NULL").select("question", "answer", F.xxhash64("question", "answer").alias("h")).orderBy("h", "question", "answer").limit(most).toPandas()
    told = verdicts.filter("abstention IS NOT NULL").groupBy("abstention").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "abstention").limit(TRAIN_ABSTENTIONS).toPandas()
    pairs = list(sample.drop_duplicates(["question", "answer"])[["question", "answer"]].itertuples(index=False, name=None))
    return train_field(pairs, told["abstention"].tolist(), words), words


def score_pairs(messages: DataFrame, verdicts: DataFrame, most: int = TRAIN_TURNS) -> DataFrame:
    """(seq, defect, answered, refused, echoed, foreign, unfinished): every distinct turn; defect is null for a good one."""
    shared = messages.sparkSession.sparkContext.broadcast(trained(messages, verdicts, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, words = shared.value
        for whole in batches:
            for a in range(0, len(whole), 1000):
                df = whole.iloc[a : a + 1000]
                found, share = defects(field, words, df["question"].tolist(), df["answer"].tolist())
                yield pd.DataFrame({"seq": df["seq"].to_numpy(), "defect": found, **{k: share[:, i].round(4) for i, k in enumerate(("answered", "refused", "echoed", "foreign", "unfinished"))}})

    return turns(messages).mapInPandas(run, "seq bigint, defect string, answered double, refused double, echoed double, foreign double, unfinished double")


def bad_pairs(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(seq, defect) of the turns with a defect."""
    return score_pairs(messages, verdicts).filter("defect IS NOT NULL").select("seq", "defect").distinct()
