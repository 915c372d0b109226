"""Noise in the text of scanned pages: broken words, misread characters, running headers and page numbers.

Words are grouped by a skeleton of confusable glyphs: every glyph is spelled in the strokes it can be taken for, so a
misreading leaves the skeleton as it is. Within a group the frequent form that the word can be a misreading of, glyph by
glyph, is chosen; the frequencies are those of the whole corpus. Headers are found with digits masked, by the skeletons
of title, site and subject, counted over the pages of their report. Lines are put into reading order by SQL windows over
one small row per page or chunk, so a report of any size never meets in one task as text.

Scale: two passes over the text. The first counts word forms inside the tasks and sums them; what is kept are the forms
with at least `MIN_SHARE` of all words, hence at most 1 / MIN_SHARE forms, and only these are broadcast. The second
pass emits the spoiled lines, and one row per item for what goes on in the next item.

Defined results: null and blank texts have no lines; repeats of an item count once; plans made twice count once; an item
without title or publisher has headers only by what is known; a table without rows gives none; equal chunk_index within
a file is ordered by id.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import written
from corvane.tables import spread

#: Forms rarer than this share of all words count as unknown; bounds the lexicon at 1 / MIN_SHARE forms.
MIN_SHARE, MIN_COUNT = 1e-6, 2
#: How many times more frequent the right form must be than its misreading.
RATIO = 8

# Glyphs and what they are misread as.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("s", "5"), ("i", "!"), ("n", "ri"), ("o", "0"), ("i", "|"), ("l", "|"), ("l", "1"), ("i", "1"),
    ("u", "ii"), ("d", "cl"), ("g", "9"), ("h", "b"), ("m", "rn"), ("rn", "m"), ("li", "h"), ("w", "vv"), ("é", "6"), ("ö", "6"), ("ó", "6"),
    ("b", "8"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"),
    ("é", "c"), ("è", "c"), ("ê", "c"), ("é", "e"), ("ü", "ii"), ("ú", "ii"), ("ñ", "ri"), ("í", "!"), ("í", "|"), ("ó", "0"), ("ö", "0"),
)
_STROKES = {
    "n": "ri", "m": "rri", "u": "ii", "h": "ii", "b": "ii", "8": "ii", "d": "ci", "w": "vv", "l": "i", "1": "i", "!": "i", "|": "i",
    "e": "c", "o": "c", "0": "c", "6": "c", "f": "t", "5": "s", "9": "g", "q": "g",
}
_HYPHENS = "-‐‑­¬"
_CONJUNCTIONS = {"und", "oder", "bzw", "and", "or", "to", "et", "ou", "y", "o", "e", "sowie"}
# Words that no heading ends with, in English, German, French and Spanish.
_NO_END = frozenset("a an the of in on at to for from by with and or as that which is are was der die das den dem des ein eine einer zu zum zur von vom im am mit und für bei auf le la les l de du des un une et à au aux en pour par sur dans que el los las del al y o con para por un una se su".split())
_EDGE = ".,;:()[]{}\"'*_#>`«»“”‘’„…?–—¿¡"

#: A hyphen at a line's end with the word that follows; what is left of the broken word gets a mark and isn't counted.
_BROKEN = re.compile(rf"[{_HYPHENS}][^\S\n]*\n\s*\S+")
_LEFT = "\0"
_PARTS = re.compile(r"[^\s\-‐‑'’/.,;:()\[\]{}\"…“”«»?–—*_#>`=+&%]+")
_HAS_WORD = re.compile(r"[^\W\d_]")
_IN_WORD = re.compile(r"[0-9!|]")


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """The strokes of a word: equal for a word and its misreadings."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return "".join(_STROKES.get(c, c) for c in bare)


_BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _good, _bad in CONFUSIONS:
    _BY_FIRST[_good[0]].append((_good, _bad))


def misreading(word: str, right: str) -> tuple[int, ...] | None:
    """The places in `word` where a glyph of `right` was misread; None if `word` isn't a misreading of it."""
    if word == right or len(word) > 60:
        return None
    # Depth first over (place in right, place in word, misread places).
    todo: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]
    seen = set()
    while todo:
        i, j, places = todo.pop()
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(right) and j == len(word):
            return places or None
        if i >= len(right) or j >= len(word):
            continue
        for good, bad in _BY_FIRST.get(right[i], ()):
            if right.startswith(good, i) and word.startswith(bad, j) and len(places) <= len(word) // 5:
                todo.append((i + len(good), j + len(bad), (*places, j)))
        if right[i] == word[j]:
            todo.append((i + 1, j + 1, places))
    return None


class Lexicon:
    """Word forms and how often the corpus has them."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts = counts
        self.least = max(MIN_COUNT, total * MIN_SHARE)
        self.groups: dict[str, list[str]] = defaultdict(list)
        for w in counts:
            if "-" not in w:
                self.groups[skeleton(w)].append(w)
        self.known: dict[str, tuple[str, tuple[int, ...]] | None] = {}
        self.fine: set[str] = set()
        self.contexts: dict[tuple[str, str], int] = {}

    def right_form(self, word: str) -> tuple[str, tuple[int, ...]] | None:
        """The form that `word` is a misreading of, and where; None if it is taken as read."""
        w = word.lower()
        if w in self.known:
            return self.known[w]
        if len(self.known) > 500_000:
            self.known.clear()
        found = None
        if len(w) > 1 and _HAS_WORD.search(w):
            own, best = self.counts.get(w, 0), 0
            # Digits and marks inside a word are no spelling; letters need a clear majority for the other form.
            odd = bool(_IN_WORD.search(w))
            for g in self.groups.get(skeleton(w), ()):
                n = self.counts[g]
                if n <= best or len(g) < 2 or _IN_WORD.search(g) or _ROMAN.match(g) or n < (max(2, 2 * own) if odd else max(5, RATIO * max(own, self.least / 4), (200 * own + 40) if len(w) < 4 else 0)):
                    continue
                if (places := misreading(w, g)) is not None:
                    found, best = (g, places), n
        self.known[w] = found
        return found

    def candidates(self, word: str) -> list[str]:
        """The forms of the word's group that it can be a misreading of, the most frequent first."""
        w = word.lower()
        found = [g for g in self.groups.get(skeleton(w), ()) if g != w and not _IN_WORD.search(g) and self.counts[g] >= 2 and misreading(w, g) is not None]
        return sorted(found, key=lambda g: (-self.counts[g], g))

    def rivals(self) -> set[str]:
        """The forms that share their group with another form that could be meant."""
        return {w for ws in self.groups.values() if len(ws) > 1 for w in ws if len(w) > 1 and not _IN_WORD.search(w) and self.counts[w] >= self.least}

    def in_context(self, word: str, before: str) -> str | None:
        """The right form of a misread word: among several the one that most often follows the word before."""
        best = self.right_form(word)
        if not best:
            return None
        options = self.candidates(word)
        if len(options) < 2:
            return best[0]
        return max(options, key=lambda g: (self.contexts.get((before, g), 0), g == best[0], self.counts[g]))

    def suspects(self, tokens: set[str]) -> set[str]:
        """Those of the tokens between blanks that have a misread word."""
        new = tokens - self.fine
        bad = {t for t in new if any(self.right_form(p) for p in _PARTS.findall(t))}
        if len(self.fine) > 500_000:
            self.fine.clear()
        self.fine |= new - bad
        return bad

    def joins(self, left: str, right: str, mark: str) -> bool:
        """Whether a word cut at a line's end goes on without the hyphen."""
        l = left.rstrip(_HYPHENS).split("/")[-1].lstrip(_EDGE)
        r = right.rstrip(_EDGE + "!").split("/")[0]
        if not l or not r or not _HAS_WORD.search(l[-1:] + "") and not _IN_WORD.search(l[-1:]):
            return False
        if not (r[0].isalpha() or r[0] in "0156!|9") or (r[0].isupper() and not l.isupper()) or r.lower() in _CONJUNCTIONS:
            return False
        r = re.split(r"[-‐‑]", r)[0] or r
        head, _, tail = l.rpartition("-")
        joined, compound = (l + r).lower(), (l + "-" + r).lower()
        one, two = self.counts.get(joined, 0) + (self.counts.get((tail + r).lower(), 0) if head else 0), self.counts.get(compound, 0)
        if one or two:
            return one >= two
        if self.right_form((tail or l) + r):
            return True
        if any(self.right_form(p) for p in (l, r)) and all((self.right_form(p) or (p.lower(),))[0] in self.counts for p in (l, r)):
            fixed = "-".join((self.right_form(p) or (p.lower(),))[0] for p in (l, r))
            if fixed in self.counts:
                return False
        if mark in "­¬":
            return True
        both = min(self.counts.get(l.lower(), 0), self.counts.get(r.lower(), 0))
        return both < 4 * self.least


# ---------------------------------------------------------------- lines of one item

_NUM = r"[0-9lIOoSs|!]{1,4}"
_DECORATED = re.compile(
    rf"^(?:[-–—]{{1,3}}\s*{_NUM}\s*[-–—]{{1,3}}|\|\s*{_NUM}(?:\s*\|)?|{_NUM}\s*\||\[\s*{_NUM}\s*\]|p{{1,2}}\.\s*{_NUM}|S\.\s*{_NUM}|{_NUM}\s*/\s*{_NUM}"
    rf"|\w{{3,7}}\W{{0,2}}\s*{_NUM}(?:\s+\w{{1,4}}\s+{_NUM})?)$"
)
_PAGE_WORDS = {skeleton(w) for w in ("page", "seite", "página", "pagina", "pag", "pág", "p", "s", "folio", "blatt")}
_ROMAN = re.compile(r"^[-–(\[]?\s*(?=[ivxlc])(c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*[-–)\]]?$")
_BARE = re.compile(r"^[0-9lIOoSs]{1,4}$")
_NUMBER_LINE = re.compile(r"^[\s\d.,()%+\-–]+$")
#: A row of a table; a line that only begins with the glyph may be a misread letter.
_TABLE_ROW = re.compile(r"^\|\s.*\|")
_SEPARATORS = re.compile(r"\s*\|\s*|\s[–—·•]\s|\s{3,}|\t+")
_NUMERIC_TOKEN = re.compile(r"^[\-–(\[]*(?=\S*\d)[0-9lIOoSs|!.,/]+[\-–)\]]*$|^[ivxlc]+$")


def page_number(line: str) -> tuple[bool, int | None]:
    """(certain, number): whether a line is a page number by its form, and a bare number that only its neighbours can tell."""
    s = line.strip()
    if not s or len(s) > 24:
        return False, None
    if _BARE.match(s):
        if any(c.isdigit() for c in s):
            return False, int(s.translate(str.maketrans("lIOoSs", "110055")))
        return False, None
    if _ROMAN.match(s):
        return True, None
    if _DECORATED.match(s) and any(c.isdigit() for c in s):
        word = re.match(r"^[^\W\d]{3,7}", s)
        if word and not s.startswith(("p.", "S.")):
            first = re.split(r"[\s\W]+", s)[0]
            return skeleton(first) in _PAGE_WORDS, None
        return True, None
    first = re.split(r"\s+", s)
    # A page word may itself be misread: "Pa9e 12", "Se!te 3 von 8".
    if len(first) in (2, 4) and skeleton(first[0].rstrip(".")) in _PAGE_WORDS and re.match(rf"^{_NUM}$", first[1]) and any(c.isdigit() for c in s):
        return True, None
    return False, None


def _masked(text: str) -> str:
    """The skeleton of a text without numbers and punctuation."""
    return skeleton(re.sub(r"[^\w!|]|_", "", "".join(w for w in text.split() if not _NUMERIC_TOKEN.match(w))))


def header_parts(line: str) -> list[str]:
    """The masked skeletons of a line's segments."""
    return [m for x in _SEPARATORS.split(line.strip()) if x and (m := _masked(x))]


class Report:
    """What a report's header can say."""

    def __init__(self, title: str | None, host: str | None, category: str | None):
        self.title = _masked(title or "")
        site = re.sub(r"^www\.", "", (host or "").strip().lower()).split(".")[0]
        self.site, self.category = _masked(site), _masked(category or "")
        self.starts = tuple(x for x in (self.title, self.site, self.category) if x)
        self.begins: dict[str, bool] = {}

    def may_begin(self, token: str) -> bool:
        """Whether a header can begin with this token: most lines begin with another word."""
        got = self.begins.get(token)
        if got is None:
            bare = _masked(token)
            # Without a known site a header may begin with any name.
            got = self.begins[token] = not bare or (not self.site and token[:1].isupper()) or any(x.startswith(bare) or bare.startswith(x) for x in self.starts)
        return got

    def header(self, line: str) -> bool:
        """Whether a line is made of the report's title (or its beginning), site and subject, with or without numbers."""
        begin = line.split(None, 1)
        if not begin or len(line) > 140 or not self.may_begin(begin[0]) or not _HAS_WORD.search(line):
            return False
        whole = _masked(line)
        if not whole:
            return False
        least = min(6, len(self.title))
        titled = lambda p: bool(self.title) and len(p) >= least and self.title.startswith(p)
        if titled(whole) or whole in (self.site, self.category):
            return True
        parts = header_parts(line)
        if len(parts) < 2:
            return False
        known = [titled(p) or p in (self.site, self.category) for p in parts]
        # Where the site isn't known, one segment of a few words beside title or subject is taken for it.
        return all(known) or (not self.site and sum(known) == len(parts) - 1 >= 1 and len(line.split()) <= 14 and line[:1].isupper())


_OUTER_NUMBERS = re.compile(r"^[\d\s]+|[\d\s]+$")


def heading(line: str, before: str | None, after: str | None) -> str | None:
    """The key of a line that may be a running header with a subject of its own: it looks like a heading and interrupts the
    text, or stands apart from it. `before` and `after` are the neighbouring lines, None where there is none or a blank one."""
    t = _OUTER_NUMBERS.sub("", line)
    if not 8 <= len(t) <= 90 or not t[0].isupper() or t[-1] in ".,;:!?|)" or t[-1] in _HYPHENS or t.count(" ") < 1 or t.rsplit(None, 1)[-1] in _NO_END:
        return None
    interrupts = before is not None and before[-1] not in ".!?:|"
    if not interrupts and after is not None and after[0].islower():
        return None
    return skeleton(re.sub(r"[^\w!|]|_", "", t))


def lines_of(text: str, report: Report, lexicon: Lexicon | None):
    """(rows, first, pending, bare, subjects) of one item.

    rows: (line_no, noise) found inside it; header rows are candidates. first: the first word of its first text line and
    that line's number; of the second, too, if the first may be a header. pending: the word its last text line is cut at,
    with mark and line number. bare: (line_no, number). subjects: (line_no, key) of lines that may be headers.
    """
    rows, bare, subjects, first = [], [], [], []
    pending = None
    lines = text.split("\n")
    kept: list[tuple[int, str]] = []
    for k, line in enumerate(lines, 1):
        s = line.strip()
        if not s:
            continue
        if len(s) <= 24:
            certain, number = page_number(s)
            if certain:
                rows.append((k, "page_number"))
                continue
            if number is not None:
                around = [next((x for x in span if x.strip() and not report.header(x)), "") for span in (lines[k - 2 :: -1] if k > 1 else [], lines[k:])]
                if not any(_NUMBER_LINE.match(x) for x in around if x):
                    bare.append((k, number))
                continue
        if len(s) <= 110 and report.header(s):
            rows.append((k, "header"))
        elif _HAS_WORD.search(s):
            kept.append((k, s))
    suspects = lexicon.suspects(set(text.split())) if lexicon else set()
    apart = [None] * len(kept)
    for i, (k, s) in enumerate(kept):
        before = kept[i - 1][1] if i and lines[k - 2].strip() else None
        apart[i] = heading(s, before, kept[i + 1][1] if i + 1 < len(kept) and lines[k].strip() else None)
        if apart[i]:
            subjects.append((k, apart[i]))
    # What may be a header is looked behind, at both ends and after a hyphen.
    first = [(kept[i][1].split(None, 1)[0], kept[i][0]) for i in range(min(2, len(kept))) if i == 0 or apart[0]]
    carried = None
    last = len(kept) - 1
    for i, (k, s) in enumerate(kept):
        cut, joined = s[-1] in _HYPHENS and len(s) > 1 and not s[-2].isspace(), None
        if cut:
            word = s.rsplit(None, 1)[-1]
            if lexicon:
                for n, following in [x for j, x in enumerate(kept[i + 1 : i + 3]) if j == 0 or apart[i + 1]]:
                    following = following.split(None, 1)[0]
                    if lexicon.joins(word, following, word[-1]):
                        joined = n
                        rows.append((k, "hyphen"))
                        rows += [(n if side else k, "misread") for side in broken_misread(word, following, lexicon)]
                        break
            if joined is None and (i == last or (i + 1 == last and apart[last])):
                pending = (word, word[-1], k)
        if suspects and not _TABLE_ROW.match(s):
            words = s.split()
            # The halves of a joined word are read as one; those of a compound that keeps its hyphen on their own.
            if not suspects.isdisjoint(words[1 if k == carried else 0 : -1 if joined or pending and pending[2] == k else None]):
                rows.append((k, "misread"))
        carried = joined or carried
    return rows, first, pending, bare, subjects


def broken_misread(left: str, right: str, lexicon: Lexicon) -> set[int]:
    """Which side (0 left, 1 right) of a broken word has misread characters."""
    l = _PARTS.findall(left.rstrip(_HYPHENS) or " ")
    r = _PARTS.findall(right)
    if not l or not r:
        return set()
    found = lexicon.right_form(l[-1] + r[0])
    sides = {int(at >= len(l[-1])) for at in found[1]} if found else set()
    if any(lexicon.right_form(p) for p in l[:-1]):
        sides.add(0)
    if any(lexicon.right_form(p) for p in r[1:]):
        sides.add(1)
    return sides


# ---------------------------------------------------------------- the tables


def scan_items(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, source, ord, item, page_no, text, title, host, category): pages and chunks in reading order."""
    of = lambda name: F.get_json_object("metadata", f"$.{name}")
    plans = spread(plans.select("source", "pages", "title", "metadata"))
    chunks = spread(chunks.select("id", "source", "chunk_index", "text", "publisher", "metadata"))
    pages = plans.select("source", F.posexplode("pages").alias("pos", "text"), F.coalesce("title", of("title")).alias("title"), of("publisher").alias("host"), of("category").alias("category")).select(
        F.lit("page").alias("kind"), "source", (F.col("pos") + 1).cast("bigint").alias("ord"), F.col("source").alias("item"), (F.col("pos") + 1).cast("int").alias("page_no"), "text", "title", "host", "category"
    )
    return pages.unionByName(chunks.select(
        F.lit("chunk").alias("kind"), "source", F.col("chunk_index").cast("bigint").alias("ord"), F.col("id").alias("item"), F.lit(0).alias("page_no"), "text",
        of("title").alias("title"), F.col("publisher").alias("host"), of("category").alias("category"),
    ))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column `text`; parts of compounds count, and compounds as a whole. Broken words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()

        def flushed() -> pd.DataFrame:
            words: Counter = Counter()
            for token, n in raw.items():
                if token[-1] == _LEFT:
                    continue
                parts = _PARTS.findall(token)
                for p in parts:
                    words[p.lower()] += n
                if len(parts) > 1 and "-" in token[1:-1]:
                    words[token.strip(_EDGE).lower()] += n
            raw.clear()
            return pd.DataFrame({"word": list(words.keys()), "n": list(words.values())})

        for df in batches:
            for text in df["text"]:
                if text:
                    raw.update(_BROKEN.sub(_LEFT + " ", text).split())
            if len(raw) > 300_000:
                yield flushed()
        if raw:
            yield flushed()

    return texts.select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(texts: DataFrame) -> Lexicon:
    """The forms with at least MIN_SHARE of all words: at most 1 / MIN_SHARE rows come to the driver."""
    counts = word_counts(texts)
    counts = counts.persist()
    try:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
        kept = counts.filter(F.col("n") >= max(MIN_COUNT, total * MIN_SHARE)).toPandas()
    finally:
        counts.unpersist()
    return Lexicon(dict(zip(kept["word"], kept["n"].astype(int))), total)


def context_counts(texts: DataFrame, rivals) -> DataFrame:
    """(before, word, n) for words that share their group with others; counted inside the tasks and summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = rivals.value
        pairs: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame({"before": [a for a, _ in pairs], "word": [b for _, b in pairs], "n": list(pairs.values())})
            pairs.clear()
            return out

        for df in batches:
            for text in df["text"]:
                words = _PARTS.findall(text.lower()) if text else []
                pairs.update((a, b) for a, b in zip(words, words[1:]) if b in wanted)
            if len(pairs) > 300_000:
                yield flushed()
        if pairs:
            yield flushed()

    return texts.select("text").mapInPandas(run, "before string, word string, n bigint").groupBy("before", "word").agg(F.sum("n").alias("n"))


def with_contexts(texts: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with the contexts of rival forms that make up at least MIN_SHARE of all words: again at most 1 / MIN_SHARE rows."""
    rivals = texts.sparkSession.sparkContext.broadcast(lexicon.rivals())
    rows = context_counts(texts, rivals).filter(F.col("n") >= lexicon.least).toPandas()
    lexicon.contexts = dict(zip(zip(rows["before"], rows["word"]), rows["n"].astype(int)))
    return lexicon


_FOUND = "kind string, source string, ord bigint, item string, page_no int, line_no int, noise string, number int, word string, mark string"


def spoiled(items: DataFrame, lexicon) -> DataFrame:
    """One row per finding of an item: noise as named, `bare` (a number to be judged), `first` and `pending` (for the next item)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon.value
        reports: dict = {}
        for df in batches:
            out = []
            for kind, source, ord_, item, page, text, title, host, category in df.itertuples(index=False):
                if not text or not text.strip():
                    continue
                who = (title, host, category)
                if who not in reports:
                    if len(reports) > 50_000:
                        reports.clear()
                    reports[who] = Report(*who)
                rows, first, pending, bare, subjects = lines_of(text, reports[who], lex)
                at = (kind, source, ord_, item, page)
                out += [(*at, k, noise, None, None, None) for k, noise in rows]
                out += [(*at, k, "bare", n, None, None) for k, n in bare]
                out += [(*at, k, "subject", None, key, None) for k, key in subjects]
                out += [(*at, k, "first", i, word, None) for i, (word, k) in enumerate(first)]
                if pending:
                    out.append((*at, pending[2], "pending", None, pending[0], pending[1]))
            if out:
                yield pd.DataFrame(out, columns=["kind", "source", "ord", "item", "page_no", "line_no", "noise", "number", "word", "mark"]).astype({"number": "Int32"})

    return items.select("kind", "source", "ord", "item", "page_no", "text", "title", "host", "category").mapInPandas(run, _FOUND)


def _continued(rows: DataFrame, lexicon) -> DataFrame:
    """Words cut at an item's last text line that go on in the next item with text."""
    ends = rows.filter(F.col("noise").isin("first", "pending"))
    begin = lambda i: F.min(F.when((F.col("noise") == "first") & (F.col("number") == i), F.struct("word", "line_no")))
    per = ends.groupBy("kind", "source", "ord", "item", "page_no").agg(
        F.array_compact(F.array(begin(0), begin(1))).alias("first"), F.min(F.when(F.col("noise") == "pending", F.struct("word", "mark", "line_no"))).alias("pending")
    )
    order = Window.partitionBy("kind", "source").orderBy("ord", "item")
    cuts = per.withColumn("next", F.lead(F.struct("item", "page_no", "first")).over(order)).filter("pending IS NOT NULL AND size(next.first) > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon.value
        for df in batches:
            out = []
            for item, page, line, cut, mark, item2, page2, words, numbers in df.itertuples(index=False):
                for word, line2 in zip(words, numbers):
                    if lex.joins(cut, word, mark):
                        out.append((item, page, line, "hyphen"))
                        out += [(item2, page2, int(line2), "misread") if side else (item, page, line, "misread") for side in broken_misread(cut, word, lex)]
                        break
                else:  # a compound: its other half was read with its own line
                    if lex.suspects({cut}):
                        out.append((item, page, line, "misread"))
            if out:
                yield pd.DataFrame(out, columns=["item", "page_no", "line_no", "noise"])

    return cuts.select("item", "page_no", "pending.line_no", "pending.word", "pending.mark", F.col("next.item").alias("item2"), F.col("next.page_no").alias("page2"), F.col("next.first.word").alias("words"), F.col("next.first.line_no").alias("lines")).mapInPandas(
        run, "item string, page_no int, line_no int, noise string"
    )


def find_noise(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, page_no, line_no, noise): the spoiled lines, distinct."""
    # Items without a source are reports of their own: they have no next item, and don't meet in one task.
    items = scan_items(plans, chunks).withColumn("source", F.coalesce("source", "item"))
    return _judged(items, items.sparkSession.sparkContext.broadcast(lexicon_of(items)))


def _judged(items: DataFrame, lexicon) -> DataFrame:
    rows = written(spoiled(items, lexicon), "noise")
    key = ["item", "page_no", "line_no", "noise"]
    distinct = rows.filter(F.col("noise").isin("header", "bare", "page_number")).distinct()
    # A header stands on several pages of its report: title, site and subject as known, or a heading of a scan that
    # comes again and again between its lines.
    often = distinct.filter("noise = 'header'").groupBy("kind", "source").agg(F.count("*").alias("n")).filter("n >= 2").select("kind", "source")
    scans = rows.filter("noise = 'hyphen'").select("kind", "source").distinct()
    subjects = rows.filter("noise = 'subject'").join(scans, ["kind", "source"], "left_semi")
    again = subjects.select("kind", "source", "word", "item", "page_no", "line_no").distinct().groupBy("kind", "source", "word").agg(F.count("*").alias("n")).filter("n >= 2").select("kind", "source", "word")
    headers = rows.filter("noise = 'header'").join(often, ["kind", "source"], "left_semi").select(*key).unionByName(subjects.join(again, ["kind", "source", "word"], "left_semi").withColumn("noise", F.lit("header")).select(*key))
    # A bare number is that of the page if the report counts on with it, if two pages of the report are as far from their
    # place, if it follows or precedes another one within few chunks, or if the report has no other that may be one.
    bare = distinct.filter("noise = 'bare'")
    runs = bare.select("kind", "source", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number")).distinct()
    forms = distinct.filter("noise = 'page_number'").select("kind", "source").distinct()
    small = bare.filter("number < 1000")
    alone = small.groupBy("kind", "source").agg(F.count("*").alias("n")).filter("n = 1").join(forms, ["kind", "source"], "left_anti").select("kind", "source")
    offset = small.filter("kind = 'page'").withColumn("offset", F.col("number") - F.col("page_no"))
    steady = offset.groupBy("source", "offset").agg(F.count_distinct("page_no").alias("n")).filter("n >= 2").select("source", "offset")
    placed = offset.join(steady, ["source", "offset"], "left_semi").select(*key)
    order = Window.partitionBy("source").orderBy("ord", "item", "line_no")
    counted = small.filter("kind = 'chunk'")
    for i in (1, 2):
        counted = counted.withColumn(f"b{i}", F.lag(F.struct("number", "ord"), i).over(order)).withColumn(f"a{i}", F.lead(F.struct("number", "ord"), i).over(order))
    follows = lambda x, y: (y("number") > x("number")) & (y("number") - x("number") <= 2 * F.greatest(F.lit(1), y("ord") - x("ord")))
    own, at = F.col, lambda c: lambda f: F.col(f"{c}.{f}")
    near = [F.coalesce(c, F.lit(False)) for i in (1, 2) for c in (follows(at(f"b{i}"), own), follows(own, at(f"a{i}")))]
    counted = counted.filter(near[0] | near[1] | near[2] | near[3]).select(*key)
    numbers = bare.join(runs, ["kind", "source", "number"], "left_semi").select(*key).unionByName(small.join(alone, ["kind", "source"], "left_semi").select(*key)).unionByName(placed).unionByName(counted).withColumn("noise", F.lit("page_number"))
    sure = rows.filter(F.col("noise").isin("hyphen", "misread", "page_number")).select(*key).unionByName(_continued(rows.filter(F.col("noise").isin("first", "pending")), lexicon).select(*key))
    # A header is only that.
    sure = sure.join(headers.select("item", "page_no", "line_no"), ["item", "page_no", "line_no"], "left_anti").select(*key)
    return sure.unionByName(headers).unionByName(numbers.select(*key)).distinct()


# ---------------------------------------------------------------- repaired text


def repaired_line(line: str, lexicon: Lexicon) -> str:
    """A line with its misread words replaced; capitals at a word's start stay. Blanks become single."""
    before = ""

    def right(m: re.Match) -> str:
        nonlocal before
        g = lexicon.in_context(m.group(), before)
        before = (g or m.group()).lower()
        if not g:
            return m.group()
        return g.upper() if m.group().isupper() and len(g) > 1 else g[0].upper() + g[1:] if m.group()[0].isupper() else g

    words = line.split()
    if not lexicon.suspects(set(words)):
        return " ".join(words)
    return " ".join(_PARTS.sub(right, w) for w in words)


def reflowed(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, source, paragraph, text): the continuous paragraphs of the reports that have spoiled lines.

    Lines lose headers and page numbers, words are repaired and broken words joined. SQL windows number the paragraphs:
    within each page or chunk over its lines, across them over one row per item; a paragraph that ends without a stop
    goes on in the next item. An item without a source is a report of its own, one without a place comes first.
    """
    items = scan_items(plans, chunks).withColumn("item", F.coalesce("item", F.lit(""))).withColumn("source", F.coalesce("source", "item")).withColumn("ord", F.coalesce("ord", F.lit(0).cast("bigint")))
    lexicon = items.sparkSession.sparkContext.broadcast(with_contexts(items, lexicon_of(items)))
    noise = written(_judged(items, lexicon), "judged")
    marks = noise.groupBy("item", "page_no").agg(
        F.collect_set(F.when(F.col("noise").isin("header", "page_number"), F.col("line_no"))).alias("drop"), F.collect_set(F.when(F.col("noise") == "hyphen", F.col("line_no"))).alias("joins")
    )
    # Only reports with spoiled lines are scans; the others' text is left as it is elsewhere.
    scans = noise.select("item", "page_no").distinct().join(items.select("kind", "source", "item", "page_no").distinct(), ["item", "page_no"]).select("kind", "source").distinct()
    texts = items.select("kind", "source", "ord", "item", "page_no", "text").join(scans, ["kind", "source"], "left_semi").join(marks, ["item", "page_no"], "left").dropDuplicates(["kind", "source", "ord", "item"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon.value
        for df in batches:
            out = []
            for kind, source, ord_, item, text, drop, joins in df.itertuples(index=False):
                gone, cut = set(drop if drop is not None else ()), set(joins if joins is not None else ())
                kept = [(k, repaired_line(line, lex)) for k, line in enumerate((text or "").split("\n"), 1) if k not in gone]
                for (k, s), (_, after) in zip(kept, [*kept[1:], (0, "")]):
                    # A compound keeps its hyphen and goes on without a blank.
                    compound = s[-1:] == "-" and s[-2:-1].isalpha() and after[:1].isalpha() and after.split()[0].lower() not in _CONJUNCTIONS
                    out.append((kind, source, ord_, item, k, s.rstrip(_HYPHENS) if k in cut else s, k in cut or compound))
            if out:
                yield pd.DataFrame(out, columns=["kind", "source", "ord", "item", "line_no", "line", "glued"])

    lines = texts.select("kind", "source", "ord", "item", "text", "drop", "joins").mapInPandas(run, "kind string, source string, ord bigint, item string, line_no int, line string, glued boolean")
    inside = Window.partitionBy("kind", "source", "ord", "item").orderBy("line_no")
    numbered = lines.withColumn("own", F.sum((F.col("line") == "").cast("int")).over(inside)).filter("line <> ''")
    # First the paragraphs of each item, by a partial aggregation over its lines.
    paragraphs = numbered.groupBy("kind", "source", "ord", "item", "own").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "glued"))).alias("l"))
    text = F.aggregate("l", F.lit(""), lambda a, x: F.concat(a, x["line"], F.when(x["glued"], F.lit("")).otherwise(F.lit(" "))))
    paragraphs = paragraphs.select("kind", "source", "ord", "item", "own", text.alias("text"))
    # Then those that go on: one short row per paragraph is ordered, its text isn't needed for that.
    order = Window.partitionBy("kind", "source").orderBy("ord", "item", "own")
    ends = paragraphs.select("kind", "source", "ord", "item", "own", F.trim("text").rlike(r"[.!?:|][\"'»”)\]]*$").alias("stops"), F.trim("text").rlike(r"^[\p{Ll}\p{N}(]").alias("low"))
    before = F.lag(F.struct("stops", "ord", "item")).over(order)
    starts = ends.withColumn("b", before).withColumn("new", (F.col("b").isNull() | F.col("b.stops") | ((F.col("b.ord") == F.col("ord")) & (F.col("b.item") == F.col("item"))) | ~F.col("low")).cast("int"))
    where = starts.withColumn("paragraph", F.sum("new").over(order)).select("kind", "source", "ord", "item", "own", "paragraph")
    joined = paragraphs.join(where, ["kind", "source", "ord", "item", "own"]).groupBy("kind", "source", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "item", "own", "text"))), lambda x: x["text"]), "").alias("text"))
    return joined.select("kind", "source", F.col("paragraph").cast("int").alias("paragraph"), F.trim("text").alias("text"))
