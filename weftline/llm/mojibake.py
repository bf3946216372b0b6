"""Garbled text from wrong character encoding.

Method: lines are joined with their near-twins on the text stripped of non-ASCII characters; where a twin's
characters align with others at the same places, the pair of encodings that turns the one into the
other is inferred; the transformations so learned are applied to all words with such characters. A word is
garbled if undoing a learned transformation gives a word that the corpus knows better. UTF-8 read as something
else shows by its form, too: few words are valid UTF-8 as bytes by chance, and of those few look odd as they are and
well restored.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import col, require, stored

__all__ = ["GarbledText", "undo", "garble", "garbled_copies", "transformations"]

# Encodings of one byte a character, and of several, by their usual names.
SINGLE_BYTE = ("latin_1 cp1252 cp1250 cp1251 cp1253 cp1254 cp1257 iso8859_2 iso8859_15 koi8_r cp866 cp437 cp850 cp852 mac_roman mac_cyrillic").split()
MULTI_BYTE = "utf_8 cp932 euc_jp gbk euc_kr big5".split()

#: Encodings that text may have been written in, and those it may have been read in: bytes that are valid
#: UTF-8 were meant to be, and others read as UTF-8 leave replacement characters.
WRITTEN = [*SINGLE_BYTE, *MULTI_BYTE]
READ = [e for e in WRITTEN if e != "utf_8"]

#: Letters that a line has to have besides its non-ASCII characters, to be told from others by them;
#: lines of fewer are told by the lines before, too.
OWN_LETTERS = 8
#: Characters (East Asian ones count twice) of a passage that is told by the pattern in which its characters recur.
PASSAGE_WEIGHT = 12
#: A word's restored form has to be in so many documents, texts or lines, and in so many times those of the word.
KNOWN_DOCUMENTS = 2
KNOWN_TIMES = 3
#: Of the twin lines that a transformation could have made of each other, the share that it did, for it to be learned.
SUPPORT = 0.05
#: Characters that a word of another single-byte encoding has at least, unless its twin shows it; fewer are too easily
#: another sign. More restored letters of one script than this show UTF-8 by themselves.
OWN_CHARACTERS = 3

_WORD = re.compile("[A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*")
_RUN = re.compile("[\x80-\U0010ffff]+")
_LETTER = re.compile("[A-Za-z]")
#: What no writer types: the replacement character, and C1 controls but for the next-line character.
_BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")
# Signs usual within prose.
_PROSE = "“”‘’„‚«»–—…¿¡°µ±§·½"


@lru_cache(maxsize=None)
def _table(encoding: str) -> tuple[str, object]:
    """Decoding and encoding tables; a byte without a character stands for the control of its number."""
    text = "".join(codecs.decode(bytes([b]), encoding, "ignore") or chr(b) for b in range(256))
    return text, codecs.charmap_build(text)


def _encode(text: str, encoding: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _table(encoding)[1])[0] if encoding in SINGLE_BYTE else text.encode(encoding)
    except UnicodeError:
        return None


def _decode(data: bytes, encoding: str) -> str | None:
    try:
        return codecs.charmap_decode(data, "strict", _table(encoding)[0])[0] if encoding in SINGLE_BYTE else data.decode(encoding)
    except UnicodeError:
        return None


def transformations() -> list[tuple[str, str]]:
    """All ``(written, read)`` pairs of encodings considered."""
    return [(w, r) for r in READ for w in WRITTEN if w != r]


def undo(text: str, written: str, read: str) -> str | None:
    """The text before it was written in one encoding and read in another, or null if that can't be."""
    data = _encode(text, read)
    back = None if data is None else _decode(data, written)
    return None if back == text else back


def garble(text: str, written: str, read: str) -> str | None:
    """The text as it comes out when written in one encoding and read in another, or null if that can't be."""
    data = _encode(text, written)
    out = None if data is None or not data else _decode(data, read)
    return None if out == text else out


def garbled_copies(transformations: list[str]):
    """For ``mapInArrow`` over ``(key, text)``: ``(key, garbled text, text, transformation)`` of the texts that have characters to garble."""

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                if t and not t.isascii():
                    for i in range(len(transformations)):
                        how = transformations[(k // 20 + i) % len(transformations)]
                        if bad := garble(t, *how.split(">")):
                            rows.append((k, bad, t, how))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "text", "original", "how"])

    return run


def _candidates(learned) -> dict[str, list[str]]:
    """What each reader's text may have been written in: what was learned, and UTF-8 always."""
    out: dict[str, list[str]] = {r: ["utf_8"] for r in READ}
    for t in sorted(learned):
        written, read = t.split(">")
        if written != "utf_8":
            out[read].append(written)
    return out


def _undone(word: str, candidates: dict[str, list[str]]) -> dict[str, list[str]]:
    """All texts that a transformation could have made into ``word``, with their transformations.

    UTF-8 misread repeatedly is undone as often as that goes on giving shorter text.
    """
    out: dict[str, list[str]] = {}
    for read, writers in candidates.items():
        data = _encode(word, read)
        if data is None or data.isascii():
            continue
        for written in writers:
            back = _decode(data, written)
            while back is not None and back != word:
                if not _BROKEN.search(back):
                    out.setdefault(back, []).append(f"{written}>{read}")
                further = undo(back, written, read) if written == "utf_8" else None
                back = further if further and len(further) < len(back) else None
    if not any(t.startswith("utf_8>") for ts in out.values() for t in ts):
        for back, ts in _undone_inside(word).items():
            out.setdefault(back, []).extend(ts)
    return out


def _undone_inside(word: str) -> dict[str, list[str]]:
    """All texts made by undoing UTF-8 misread in single bytes in parts of ``word`` only.

    A part that can be undone is a lead byte and its continuation bytes, as characters of the reader; what
    stands beside them stays: prose signs, blanks, and characters that the reader doesn't have. Others that the
    reader has would have been misread as well, so that the parts are there by chance.
    """
    out: dict[str, list[str]] = {}
    for read in SINGLE_BYTE:
        beside = _RUN.findall(_parts(read).sub(" ", word))
        if any(c not in _PROSE and not c.isspace() and _encode(c, read) is not None for run in beside for c in run):
            continue
        back = word
        while (further := _parts(read).sub(lambda m: undo(m[0], "utf_8", read) or m[0], back)) != back:  # noqa: B023
            back = further
        if back != word and not _BROKEN.search(back) and _odd(back) < _odd(word):
            out.setdefault(back, []).append(f"utf_8>{read}")
    return out


@lru_cache(maxsize=None)
def _parts(read: str) -> re.Pattern:
    """Characters that valid UTF-8 of several bytes is read as."""
    text = _table(read)[0]
    of = lambda first, last: "[" + re.escape(text[first : last + 1]) + "]"
    more = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{more}|{of(0xF0, 0xF4)}{more}{more}{more})+")


def _natural(text: str) -> bool:
    """Whether all characters are assigned ones that texts are made of: no controls, private or undefined code points."""
    return not any(c > "\x7f" and unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in text)


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """The script of a letter by its Unicode name, e.g. LATIN or ARABIC; East Asian ones are one; no letter has none."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").replace("-", " ").split(" ", 1)[0]
    return "EAST ASIAN" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "FULLWIDTH", "HALFWIDTH", "BOPOMOFO") else name


def _plain(text: str) -> bool:
    """Whether all non-ASCII characters are letters, or signs that are usual within prose."""
    return _natural(text) and all(c <= "\x7f" or c.isalpha() or c in _PROSE or "\u3000" <= c <= "\u30ff" or c >= "\uff00" for c in text)


def _shows(word: str, back: str, reads: list[str]) -> bool:
    """Whether ``word`` is UTF-8 misread by its form alone.

    Either several letters of one script come out, or the word looks odd and its restored form less so. In the latter
    case one restored letter is to fit the others in script, and it takes a reader of single bytes: any two
    characters of several bytes may be valid by chance.
    """
    if not _natural(back):
        return False
    made = [c for c in back if c > "\x7f"]
    kinds = {unicodedata.category(c) for c in made}
    if kinds == {"Cf"}:
        return len(word) >= len(back) + 2
    if len(made) > OWN_CHARACTERS and all(k[0] in "LM" for k in kinds) and len({_script(c) for c in made} - {""}) == 1:
        return True
    single = any(r in SINGLE_BYTE for r in reads)
    return single and _odd(back) < _odd(word) and (len(made) > 1 or len({_script(c) for c in back} - {""}) <= 1)


class _Kinds(dict):
    """Characters by kind: l, c, g small letters of Latin, Cyrillic, Greek, a those of Latin with accents, and
    their capitals; s other signs, x what is not natural, o further letters and what is usual in prose."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c <= "\x7f":
            kind = "l" if c.isalpha() else " "
        elif not _natural(c):
            kind = "x"
        elif unicodedata.category(c) in ("Mn", "Mc", "Cf", "Zs"):
            kind = "o"
        elif not c.isalpha() or 0xFF61 <= code <= 0xFF9F:
            kind = "o" if c in _PROSE or 0x3000 <= code <= 0x303F or code >= 0xFF00 and not 0xFF61 <= code <= 0xFF9F else "s"
        else:
            kind = {"LATIN": "a", "GREEK": "g", "CYRILLIC": "c"}.get(_script(c), "o")
        self[code] = kind = kind.upper() if c.isupper() else kind
        return kind


_KINDS = _Kinds()
_ODD = re.compile("x|(?<=[laLA])[cgCG]|(?<=[cC])[laLAgG]|(?<=[gG])[laLAcC]|(?<=[lacg])[LACG]|(?<=[lacgLACG])s|s(?=[lacgLACG])|[aA]{3,}")


def _odd(text: str) -> int:
    """Places that hardly occur in prose: capitals after small letters, scripts mixed, signs within words."""
    return len(_ODD.findall(text.translate(_KINDS)))


def _tokens(line: str) -> dict[tuple[int, int], str]:
    """The words with non-ASCII characters by their place in the line stripped of such characters."""
    out, gone = {}, 0
    for m in _WORD.finditer(line):
        ascii_only = len(_RUN.sub("", m[0]))
        at = m.start() - gone
        out[at, at + ascii_only] = m[0]
        gone += len(m[0]) - ascii_only
    return out


def _runs(line: str) -> dict[int, str]:
    """The runs of non-ASCII characters by their place in the line stripped of them."""
    out, gone = {}, 0
    for m in _RUN.finditer(line):
        out[m.start() - gone] = m[0]
        gone += len(m[0])
    return out


def _pattern(units) -> bytes:
    """Where the units recur, whatever they are: any one-to-one replacement of them leaves this as it is."""
    first: dict = {}
    return b"".join(first.setdefault(u, len(first)).to_bytes(2, "little") for u in units)


def _passages(line: str):
    """``(pattern, passage)`` of runs of words, of few ASCII letters, that have the weight to be told by their pattern.

    A passage read in another single-byte encoding keeps its pattern. If it was written in two bytes a character, its
    pattern by twos is that of the original by characters.
    """
    found = list(_WORD.finditer(line))
    for k in range(len(found)):
        weight, foreign, end = 0, 0, k
        while end < len(found) and weight < PASSAGE_WEIGHT:
            if end > k and _LETTER.search(line, found[end - 1].end(), found[end].start()):
                break
            own = "".join(_RUN.findall(found[end][0]))
            weight += sum(2 if c >= "\u3000" else 1 for c in own)
            foreign += len(found[end][0]) - len(own)
            end += 1
        if weight < PASSAGE_WEIGHT or 2 * foreign > weight:
            continue
        words = [m[0] for m in found[k:end]]
        text = " ".join(words)
        if len(text) <= _MOST_UNITS:
            yield _pattern(text), text
            if all(len(w) % 2 == 0 and max(w) < "\u3000" for w in words):
                yield _pattern(x for w in words for x in (*(w[i : i + 2] for i in range(0, len(w), 2)), " "))[:-2], text


def _between(garbled: str, clean: str) -> list[str]:
    """Transformations that turn ``clean`` into ``garbled``; UTF-8 may have been misread repeatedly."""
    out = []
    for read in READ:
        if (data := _encode(garbled, read)) is not None:
            out += [f"{w}>{read}" for w in WRITTEN if w != read and _encode(clean, w) == data]
            last, back = garbled, _decode(data, "utf_8")
            while back and clean != back and len(back) < len(last):
                last, back = back, undo(back, "utf_8", read)
                if back == clean:
                    out.append(f"utf_8>{read}")
    return out


def _able(garbled: list[str], clean: list[str]) -> list[str]:
    """Transformations between single-byte encodings that could be between these runs, whether or not they are."""
    if any(len(g) != len(c) for g, c in zip(garbled, clean)):
        return []
    reads = [e for e in SINGLE_BYTE if all(_encode(g, e) is not None for g in garbled)]
    writes = [e for e in SINGLE_BYTE if all(_encode(c, e) is not None for c in clean)]
    return [f"{w}>{r}" for r in reads for w in writes if w != r]


def _restored_line(line: str, table: dict, n: list[int]) -> str:
    """The line with its garbled words replaced; ``n`` counts those restored and those that stay."""
    ways = sorted({how for m in _WORD.finditer(line) if (f := table.get(m[0])) and f["how"] for how in f["how"]})

    def alike(word: str, how: str) -> str | None:
        back = undo(word, *how.split(">"))
        if back is None or _BROKEN.search(back):
            return None
        if how.startswith("utf_8>"):
            return back if _natural(back) else None
        return back if len(word) < OWN_CHARACTERS and len(back) == len(word) and _plain(back) else None

    def one(m: re.Match) -> str:
        word, back = m[0], None
        if word in table and table[word]["restored"] is not None:
            back = table[word]["restored"]
        else:
            back = next((x for how in ways if (x := alike(word, how))), None)
        n[0] += back is not None
        n[1] += back is None and word in table
        return word if back is None else back

    return _WORD.sub(one, line)


def _best(chosen: DataFrame) -> DataFrame:
    """Each word's candidate in most documents; of equals, by the transformation that shows in most words."""
    best = chosen.groupBy("word").agg(F.max(F.struct("m", "usual", (-F.length("restored")).alias("short"), "restored", "how")).alias("b"))
    return best.select("word", "b.restored", "b.how")


def _settled(chosen: DataFrame) -> DataFrame:
    """``(word, restored, how)``: each word's best candidate that is not garbled itself, or what that goes back to.

    Of words whose candidates all are garbled, the candidates' own are followed, doubling the steps each
    time, until no more come to an end.
    """
    garbled = chosen.select(F.col("word").alias("restored")).distinct()
    done = stored(_best(chosen.join(garbled, "restored", "left_anti")))
    open_ = stored(_best(chosen.join(done, "word", "left_anti")))
    left = open_.count()
    while left:
        step = done.unionByName(open_).select(F.col("word").alias("restored"), F.col("restored").alias("next"), F.col("how").alias("more"))
        moved = open_.join(step, "restored").select("word", F.col("next").alias("restored"), F.array_union("how", "more").alias("how"))
        moved = stored(moved.join(garbled.withColumn("again", F.lit(True)), "restored", "left"))
        done = done.unionByName(moved.where("again is null").drop("again").select("word", "restored", "how"))
        open_ = moved.where("again").select("word", "restored", "how")
        before, left = left, open_.count()
        if left == before:  # these turn into each other: there is no telling
            break
    return done.unionByName(open_.select("word", F.lit(None).cast("string").alias("restored"), "how"))


#: Units of a pattern, two bytes each. Longer passages are none: a passage ends with the word that gives it the weight.
_MOST_UNITS = 1 << 16
_TWIN_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
_GUESS_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))


class GarbledText:
    """The affected documents of a corpus, and their restored text.

    ``words`` has ``(key, word, digest)``, each word with non-ASCII characters of each document and its text; ``verdicts`` has
    ``(word, restored, how)`` for each garbled word: its original, null where that can't be had, and the
    transformations that it went through.

    Null and empty texts are not affected, nor are texts of ASCII only. Repeated rows are kept: a
    document comes out once for each identifier, null identifiers as one. Whole texts are read; further
    columns are ignored, and an empty table gives empty results.
    """

    def __init__(self, documents: DataFrame, *, key: str, text: str):
        require(documents, key, text)
        self.key, self.text, self.documents = key, text, documents
        self.spark = documents.sparkSession
        self.words = stored(self._words())
        self.variants = stored(self._lines().groupBy("whole", "skeleton", "line").agg(F.count("*").alias("n"), F.first("odd").alias("odd")))
        self.twins = stored(self._twins())
        self.learned = self._learned()
        self.verdicts = self._verdicts()

    def _source(self) -> DataFrame:
        return self.documents.select(col(self.key).alias("key"), col(self.text).cast("string").alias("text"))

    def _words(self) -> DataFrame:
        schema = T.StructType([T.StructField("key", self.documents.schema[self.key].dataType), T.StructField("word", T.StringType()), T.StructField("digest", T.LongType())])

        def split(batches):
            for b in batches:
                at, out, digests = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t and not t.isascii():
                        mine = set(_WORD.findall(t))
                        at += [i] * len(mine)
                        out += sorted(mine)
                        digests += [xxhash.xxh3_64_intdigest(t.encode()) - 2**63] * len(mine)
                columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(digests, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "digest"])

        return self._source().mapInArrow(split, schema)

    def _lines(self) -> DataFrame:
        """``(skeleton, line, odd, whole)``: lines with non-ASCII characters by what is left without these, and passages
        by the pattern of their characters (not ``whole``). Skeletons are hashed."""
        schema = T._parse_datatype_string("skeleton binary, line string, odd int, whole boolean")

        def told(line: str) -> tuple:
            """What the line leaves without non-ASCII characters, whether that is little, how odd it is, and its passages."""
            own = _RUN.sub("", line)
            few = len(_LETTER.findall(own)) < OWN_LETTERS
            return own.encode(), few, _odd(line), [(xxhash.xxh3_128_digest(pattern), text, _odd(text)) for pattern, text in _passages(line)]

        def strip(batches):
            again = lru_cache(maxsize=1 << 13)(told)  # lines recur: of short ones the last are kept
            for b in batches:
                keys, lines, odd, whole = [], [], [], []
                for t in b.column(0).to_pylist():
                    if not t or t.isascii():
                        continue
                    before = b""  # the last line that can be told by itself, or a digest of those since
                    for line in t.split("\n"):
                        line = line.strip(" \t\r+-")
                        if line.isascii():
                            before = line.encode() or before
                            continue
                        own, few, how_odd, passages = again(line) if len(line) < 500 else told(line)
                        before = xxhash.xxh3_128_digest(before + own if few else own)
                        keys.append(before), lines.append(line), odd.append(how_odd), whole.append(True)
                        for pattern, text, how_odd in passages:
                            keys.append(pattern), lines.append(text), odd.append(how_odd), whole.append(False)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.string()), pa.array(odd, pa.int32()), pa.array(whole, pa.bool_())], names=schema.names)

        return self._source().select("text").mapInArrow(strip, schema)

    def _twins(self) -> DataFrame:
        """What the twins show: ``(how, n, able)`` sums of lines, and ``(word, restored, how, sure)`` of their words.

        Of the lines or passages with one skeleton the most frequent and the least odd stand for all, and each other one is
        aligned with these; the odder of the two is the garbled one, and where neither is odder both ways are
        tried. A line shows a transformation if that explains all runs of characters that differ, and it is sure which
        word is garbled if it is odder than its twin.
        """
        most = F.max(F.struct("n", (-F.length("line")).alias("short"), "line"))["line"]
        least = F.max(F.struct((-F.col("odd")).alias("even"), "n", (-F.length("line")).alias("short"), "line"))["line"]
        reps = self.variants.groupBy("whole", "skeleton").agg(F.array_distinct(F.array(most, least)).alias("reps"), F.count("*").alias("k")).where("k > 1")
        pairs = self.variants.join(reps, ["whole", "skeleton"]).select("line", F.explode("reps").alias("clean"), "whole").where(F.col("line") != F.col("clean"))
        schema = T._parse_datatype_string("how string, n long, able long, word string, restored string, sure boolean")

        def align(batches):
            between = lru_cache(maxsize=100_000)(_between)
            for b in batches:
                shown, able, words = Counter(), Counter(), set()
                for line, clean, lines in zip(*(c.to_pylist() for c in b.columns)):
                    odder = _odd(line) - _odd(clean)
                    for garbled, good in ((line, clean),) * (odder >= 0) + ((clean, line),) * (odder <= 0):
                        here, there = (_runs(garbled), _runs(good)) if lines else (dict(enumerate(garbled.split(" "))), dict(enumerate(good.split(" "))))
                        places = [p for p, run in here.items() if there.get(p, run) != run]
                        if not places:
                            continue
                        ways = [set(between(here[p], there[p])) for p in places]
                        whole = set.intersection(*ways)
                        shown.update(whole)
                        if not any(t.startswith("utf_8>") for t in whole):
                            able.update(_able([here[p] for p in places], [there[p] for p in places]))
                        if any(ways):
                            theirs = _tokens(good) if lines else there
                            for place, word in (_tokens(garbled) if lines else here).items():
                                other = theirs.get(place)
                                if other and other != word:
                                    words.update((t, word, other, _odd(word) > _odd(other)) for t in between(word, other))
                rows = [(t, shown[t], able[t], None, None, None) for t in sorted({*shown, *able})] + [(t, 0, 0, *x) for t, *x in sorted(words)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, _TWIN_KINDS)], names=schema.names)

        return pairs.mapInArrow(align, schema)

    def _learned(self) -> dict[str, tuple[int, int]]:
        """Transformations with the twin lines that show each, and those that it could have explained.

        There are as many as pairs of encodings at most. Support is a share, so that chance does not teach more as a corpus grows.
        """
        sums = self.twins.groupBy("how").agg(F.sum("n").alias("n"), F.sum("able").alias("able")).toArrow().to_pylist()
        self.shown = {r["how"]: (r["n"], r["able"]) for r in sums}
        return {t: x for t, x in self.shown.items() if x[0] and x[0] >= SUPPORT * x[1]}

    def _verdicts(self) -> DataFrame:
        def split(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column(0).to_pylist() for w in set(_WORD.findall(t))], pa.string())], names=["word"])

        # Copies count in rows; of texts and lines, each counts once.
        texts = self.words.groupBy("word", "digest").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
        lines = self.variants.where("whole").select("line").mapInArrow(split, "word string").groupBy("word").agg(F.count("*").alias("lines"))
        known = texts.join(lines, "word", "left").select("word", "n", "texts", F.coalesce("lines", F.lit(1)).alias("lines"))
        # Small by bytes but not by the work that words are: a fixed number of partitions is not coalesced.
        known = stored(known.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "word"))
        candidates = _candidates(self.learned)
        schema = T._parse_datatype_string("word string, n long, texts long, lines long, restored string, odder long, utf8 boolean, shows boolean, how array<string>")

        def guess(batches):
            for b in batches:
                rows = []
                for w, *counts in zip(*(c.to_pylist() for c in b.columns)):
                    for r, ts in _undone(w, candidates).items():
                        reads = [t.split(">")[1] for t in ts if t.startswith("utf_8>")]
                        how = [f"utf_8>{x}" for x in reads] or ts
                        rows.append((w, *counts, r, _odd(w) - _odd(r), bool(reads), bool(reads) and _shows(w, r, reads), how))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, _GUESS_KINDS)], names=schema.names)

        guesses = known.mapInArrow(guess, schema)
        theirs = known.select(F.col("word").alias("restored"), F.col("n").alias("m"), F.col("texts").alias("m_texts"), F.col("lines").alias("m_lines"))
        twins = self.twins.where("word is not null").groupBy("word", "restored").agg(F.max("sure").alias("sure"))
        judged = guesses.join(theirs, "restored", "left").join(twins, ["word", "restored"], "left")
        many = lambda m, n: (F.col(m) >= KNOWN_DOCUMENTS) & (F.col(m) >= KNOWN_TIMES * F.col(n))
        odder, more = F.col("odder"), F.col("m_texts") > F.col("texts")
        by_count = (many("m", "n") & ((odder >= 0) | more)) | (many("m_texts", "texts") & (odder >= 0))
        # One clean line may be in many texts, and be garbled in several ways: lines count for what is odd only.
        by_lines = many("m_lines", "lines") & (odder > 0)
        # A word with a twin is known by it, and only which of the two is garbled is open.
        by_twin = F.coalesce(F.col("sure") | (F.col("sure").isNotNull() & (odder >= 0) & more), F.lit(False))
        better = F.coalesce(by_count | by_lines, F.lit(False)) | by_twin
        judged = judged.where(better | F.col("shows")).select("word", "restored", F.coalesce("m", F.lit(0)).alias("m"), "utf8", by_twin.alias("by_twin"), "how")

        def check(batches):
            for b in batches:
                keep = [u or ((len(w) >= OWN_CHARACTERS or t) and _plain(r)) for w, r, u, t in zip(*(b.column(k).to_pylist() for k in ("word", "restored", "utf8", "by_twin")))]
                yield b.filter(pa.array(keep, pa.bool_()))

        chosen = stored(judged.mapInArrow(check, judged.schema))
        words = chosen.select(F.explode("how").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()  # a row a transformation
        usual = F.create_map(*[F.lit(x) for pair in zip(words["t"].to_pylist(), words["n"].to_pylist()) for x in pair]) if len(words) else None
        best = _settled(chosen.withColumn("usual", F.lit(0).cast("long") if usual is None else F.array_max(F.transform("how", lambda t: usual[t]))))
        broken = known.where(F.col("word").rlike("[\\x{FFFD}\\x{80}-\\x{84}\\x{86}-\\x{9f}]")).select("word")
        return broken.union(best.select("word")).distinct().join(best, "word", "left")

    def found(self) -> DataFrame:
        """``(key)``: the affected documents."""
        return self.words.join(self.verdicts.select("word"), "word", "left_semi").select(F.col("key").alias(self.key)).distinct()

    def restored(self) -> DataFrame:
        """``(key, restored_text, n_restored, n_lost)`` of each affected document.

        Garbled words are replaced by their originals, again and again where they were garbled repeatedly;
        ``n_lost`` words have none and stay. Words too short to be judged by themselves follow the others of their
        line. The verdicts of a document come to it by a join on its words.
        """
        hits = self.words.select("key", "word").join(self.verdicts, "word")
        per_doc = hits.distinct().groupBy("key").agg(F.collect_list(F.struct("word", "restored", "how")).alias("fixes"))
        schema = T.StructType(
            [T.StructField("key", self.documents.schema[self.key].dataType), T.StructField("restored_text", T.StringType())]
            + [T.StructField("n_restored", T.LongType()), T.StructField("n_lost", T.LongType())]
        )
        def fix(batches):
            for b in batches:
                texts, good, lost = [], [], []
                for t, fixes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    lines, n = [], [0, 0]
                    table = {f["word"]: f for f in fixes}
                    for line in t.split("\n"):
                        lines.append(line if line.isascii() else _restored_line(line, table, n))
                    texts.append("\n".join(lines)), good.append(n[0]), lost.append(n[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(good, pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

        joined = self._source().join(per_doc, "key").select("key", "text", "fixes")
        return joined.mapInArrow(fix, schema).withColumnRenamed("key", self.key)
