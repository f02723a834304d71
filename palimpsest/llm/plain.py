"""One plain form for text that looks the same in different characters.

A transducer over grapheme clusters, compiled once per process and run once over a value. It has two parts. The mapping
gives each character's ordinary one; it is computed from the Unicode tables and checked for conflicts (each output is
plain itself, and no input has two outputs). A trie holds every letter that is composed of a base and marks, under the
mapped characters it is made of; the longest match from each place of a cluster is written out. Word context is the
transducer's state: the letters of a word are held until it ends, and then a Latin letter inside a Cyrillic word becomes
Cyrillic, and a look-alike letter of another script inside a Latin word or a letter-and-digit code becomes Latin; a word
of nothing but look-alikes is settled by the other words when the value ends. Values without any suspicious character
are recognised by one search for a character class.

Plain form: Latin letters and digits in normal width, accents composed, ordinary spaces, nothing invisible, unified
ideographs instead of radicals and compatibility forms. Chinese punctuation, words that are properly Cyrillic or
Greek, line breaks and tabs stay.

Defined results: NULL stays NULL, the empty text stays empty, a text of invisible characters only becomes empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# CJK radical forms without a compatibility mapping, and the unified ideographs they stand for.
RADICALS = dict(
    zip(
        "⺅⺆⺉⺋⺎⺏⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺨⺬⺭⺮⺯⺰⺱⺶⺹⺺⺼⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "亻冂刂㔾兀尣巳幺彑彐忄㣺扌攵旡月歺民氵氺灬爫犭示礻竹糸纟罓羊耂肀月艹虎衤覀西见角讠贝车辶阝钅長镸长门阝雨青韦页风飞食饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
        strict=True,
    )
)

# Cyrillic and Greek letters that look like Latin ones.
CYRILLIC = dict(zip("АВЕКМНОРСТХУІЈЅԚԜаеорсухіјѕһԁԛԝӏ", "ABEKMHOPCTXYIJSQWaeopcyxijshdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυκα", "ABEZHIKMNOPTYXovipuka", strict=True))
# Letters of other scripts that look like Latin ones.
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏏᏔᏕᏙᏚᏞᏟᏢᏦᏧ", "DRTiAJEWMHYGZ4bWSVSLCPKd", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
ARMENIAN = dict(zip("օոսհցզՍՕ", "onuhgqUO", strict=True))
TO_LATIN = CYRILLIC | GREEK | CHEROKEE | LISU | ARMENIAN
TO_CYRILLIC = {latin: c for c, latin in reversed(CYRILLIC.items())}

INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u2028-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    "\ufff0-\ufff8\U000e0000-\U000e0fff"
)
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WIDE = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff02-\uff07\uff0a\uff0b\uff0d-\uff0f\uff1c-\uff1e\uff20\uff3b-\uff40\uff5b-\uff5d\uff65-\uff9f"
IDEOGRAPHS = "\u2e80-\u2fdf\uf900-\ufaff\U0002f800-\U0002fa1f"
STYLED = "\U0001d400-\U0001d7ff"
MARKS = "\u0300-\u036f"

#: A value without a match of this is plain.
SUSPICIOUS = f"[{INVISIBLE}{SPACES}{WIDE}{IDEOGRAPHS}{STYLED}{MARKS}{''.join(TO_LATIN)}]"


def _compile() -> dict[str, str]:
    """The mapping of single characters, checked for conflicts."""
    mapping: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source == target:
            return
        if mapping.setdefault(source, target) != target:
            raise ValueError(f"two outputs for {source!r}")

    def expand(ranges: str):
        i = 0
        while i < len(ranges):
            if ranges[i + 1 : i + 2] == "-":
                yield from map(chr, range(ord(ranges[i]), ord(ranges[i + 2]) + 1))
                i += 3
            else:
                yield ranges[i]
                i += 1

    for c in expand(INVISIBLE):
        put(c, "")
    for c in expand(SPACES):
        put(c, " ")
    for source, target in RADICALS.items():
        put(source, target)
    for c in expand(WIDE + IDEOGRAPHS + STYLED):
        if c not in mapping:
            put(c, unicodedata.normalize("NFKC", c))
    for source, target in mapping.items():
        if any(t in mapping for t in target):
            raise ValueError(f"the output of {source!r} is no plain form")
    return mapping


def _composed(mapping: dict[str, str]) -> dict:
    """Trie of the letters with marks by their canonical parts; a node's letter is under the empty key."""
    trie: dict = {}
    for code in range(0xC0, 0x30000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) < 2 or letter in mapping or unicodedata.normalize("NFC", parts) != letter:
            continue
        node = trie
        for c in parts:
            node = node.setdefault(c, {})
        if node.setdefault("", letter) != letter:
            raise ValueError(f"two letters for {parts!r}")
    return trie


class _Word:
    """State inside a word: its letters so far and what they tell about its script."""

    def __init__(self):
        self.letters: list[str] = []
        self.alien = self.latin = self.digit = self.own = self.greek = False

    def add(self, letter: str, kind: str, greek: bool) -> None:
        self.letters.append(letter)
        self.alien |= kind == "alien"
        self.latin |= kind == "latin"
        self.digit |= kind == "digit"
        self.own |= kind == "own"
        self.greek |= greek

    def settled(self) -> str | None:
        """The word in its script, or None if the other words of the value decide."""
        if not self.alien:
            return "".join(self.letters)
        if self.own:
            return "".join(TO_CYRILLIC.get(x, x) for x in self.letters) if self.latin and not self.greek else "".join(self.letters)
        return self.as_latin() if self.latin or self.digit else None

    def as_latin(self) -> str:
        return "".join(TO_LATIN.get(x, x) for x in self.letters)


@lru_cache(1)
def _transducer():
    mapping = _compile()
    trie = _composed(mapping)
    cluster = regex.compile(r"\X")
    emoji = regex.compile(r"\p{Extended_Pictographic}")
    suspicious = re.compile(SUSPICIOUS)
    latin, greek = regex.compile(r"\p{Script=Latin}"), regex.compile(r"\p{Script=Greek}")
    foreign = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Cherokee}\p{Script=Lisu}\p{Script=Armenian}]")
    mark = regex.compile(r"\p{M}")

    @lru_cache(20_000)
    def kind_of(letter: str) -> tuple[str, bool]:
        """What a letter is to the word it stands in, or that it ends the word; and whether it is Greek."""
        c = letter[0]
        if c in TO_LATIN:
            kind = "alien"
        elif latin.match(c):
            kind = "latin"
        elif c in "0123456789":
            kind = "digit"
        elif foreign.match(c):
            kind = "own"
        else:
            kind = "mark" if mark.match(c) else ""
        return kind, bool(greek.match(c))

    @lru_cache(20_000)
    def letters_of(cluster: str) -> tuple[str, ...]:
        """Longest matches from the left over the mapped characters of a cluster, marks in canonical order."""
        if len(cluster) > 1 and emoji.match(cluster):  # joiners and selectors are part of the picture
            return (cluster,)
        if cluster in mapping and len(mapping[cluster]) < 2:
            return (mapping[cluster],) if mapping[cluster] else ()
        parts = unicodedata.normalize("NFD", "".join(mapping.get(x, x) for x in cluster)) if len(cluster) > 1 else mapping.get(cluster, cluster)
        out, i = [], 0
        while i < len(parts):
            node, end, best = trie, i + 1, parts[i]
            for j in range(i, len(parts)):
                node = node.get(parts[j])
                if node is None:
                    break
                if "" in node:
                    end, best = j + 1, node[""]
            out.append(best)
            i = end
        whole = "".join(out)
        # A mark that stands between a base and its own mark, and Hangul, are composed by the general rule.
        return tuple(out) if whole.isascii() or unicodedata.is_normalized("NFC", whole) else tuple(unicodedata.normalize("NFC", whole))

    def plain(value: str) -> str:
        if not suspicious.search(value):
            return value
        out: list[str] = []
        open_words: list[tuple[int, _Word]] = []
        word, has_latin, has_own = None, False, False

        def close() -> None:
            nonlocal has_latin, has_own
            text = word.settled()
            has_latin, has_own = has_latin or word.latin, has_own or word.own
            if text is None:
                open_words.append((len(out), word))
                text = ""
            out.append(text)

        for c in cluster.findall(value):
            for letter in letters_of(c):
                kind, is_greek = kind_of(letter)
                if kind:
                    word = word or _Word()
                    word.add(letter, kind, is_greek)
                    continue
                if word:
                    close()
                    word = None
                out.append(letter)
        if word:
            close()
        for at, held in open_words:
            out[at] = held.as_latin() if not has_own and (has_latin or len(held.letters) == 1) else "".join(held.letters)
        text = "".join(out)
        return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    return lru_cache(20_000)(plain)


def plain(value: str | None) -> str | None:
    """The plain form of one text."""
    return None if value is None else _transducer()(value)


@F.pandas_udf(StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    f = _transducer()
    return values.map(lambda v: None if v is None else f(v))


def with_plain_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the plain form of ``column`` as ``out``."""
    return df.withColumn(out, _plain_udf(column))


def not_plain(df: DataFrame, key: str, column: str) -> DataFrame:
    """The keys of the rows whose value is not in plain form."""
    kind = df.schema[key].dataType.simpleString()

    def select(batches):
        f = _transducer()
        for batch in batches:
            values = batch.column(1).to_pylist()
            at = [i for i, v in enumerate(values) if v is not None and f(v) != v]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32()))], [key])

    return df.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(select, f"`{key}` {kind}")
