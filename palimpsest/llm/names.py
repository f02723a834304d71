"""Spellings of names attributed to persons by a noisy channel.

Spellings are counted per book. Full names are the candidate canonical forms; every other spelling, and every rarer
full name, is attributed to the candidate with the largest posterior: its frequency times the likelihood that it was
written in this way (title, swapped or doubled characters, look- or sound-alike character, transcription, initial,
nickname, missing part, typing error). The likelihoods of look-alike characters, nicknames and titles are learned from
the whole table. Candidates meet spellings on blocking keys, so that no book is gathered in one place.

Attribution has two stages. Full names first: their links are closed to persons. Then all other spellings, whose
posterior is summed over the forms of each person; a spelling that fits several persons alike stays alone.

Defined results: NULL and blank names and the words for anybody are no names; a NULL book is no book; a name without
letters stays alone; repeated rows only count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.plain import with_plain_form
from palimpsest.plans.shared import materialize, release

# Words that may stand for anybody.
ANYBODY = ("她", "师姐", "夫人", "小姐", "那位姑娘")
# What is put around a name. Other titles are learned.
SUFFIXES, NICK_PREFIXES, NICK_SUFFIX, COURTESY = ("姑娘", "姐"), ("阿", "小"), "儿", ("lady", "miss", "mrs", "dame", "madame")
# Surnames that are read otherwise than the character usually is.
SURNAME_READINGS = {"曾": "zeng", "单": "shan", "解": "xie", "仇": "qiu", "区": "ou", "朴": "piao", "查": "zha", "盖": "ge", "覃": "qin", "任": "ren"}

#: Look-alike pairs and nicknames are broadcast; with more entries than this the search is refused, none is dropped.
MOST_LEARNED = 2_000_000
#: Least share of the posterior that a spelling's person must have.
CERTAIN = 0.6

_HAN = re.compile("^[一-鿿㐀-䶿\U00020000-\U000323af]+$")
_TITLED = re.compile(r"^(.+?)(?:[（(](.+?)[)）]|·(.+))$")
_QUOTED = re.compile(r'[“"«„](.+?)[”"»“]')


def readings(spark: SparkSession) -> dict[str, str]:
    """Transcription of every Han character without tones, from the session's Unicode library."""
    library = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    return {c: r.strip() for c, r in zip(chars, library.transliterate(" | ".join(chars)).split("|"), strict=True) if r.strip().isascii()}


def fold(token: str) -> str:
    """Lower case without accents and marks."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if c.isalpha())


@dataclass
class Knowledge:
    """What the channel knows: transcriptions, look-alike characters with counts, nicknames with counts."""

    read: dict[str, str]
    alike: dict[tuple[str, str], int] = field(default_factory=dict)
    nicks: dict[str, dict[str, int]] = field(default_factory=dict)

    def transcribe(self, name: str) -> tuple[str, str]:
        head = SURNAME_READINGS.get(name[0]) or self.read.get(name[0], "?")
        return head, "".join(self.read.get(c, "?") for c in name[1:])


@dataclass(frozen=True)
class Form:
    """A parsed spelling: what it is and its parts; ``full`` forms can be canonical."""

    kind: str
    parts: tuple[str, ...]
    full: bool = False
    nick: str = ""


def parse(name: str, known: Knowledge, title: int = 0) -> Form:
    """Kind and parts of a spelling that begins with a title of ``title`` characters."""
    name = " ".join(name.split())
    titled = _TITLED.match(name)
    if titled and _HAN.match(titled.group(1)):
        name = titled.group(1)
    if _HAN.match(name):
        if title and len(name) - title >= 2:
            name = name[title:]
        if name.endswith(SUFFIXES[0]) and len(name) > 3:
            name = name[: -len(SUFFIXES[0])]
        if name.endswith(SUFFIXES[1]) and len(name) in (2, 3):
            return Form("given", (name[:-1],))
        if len(name) == 2 and name[0] in NICK_PREFIXES:
            return Form("nick", (name[1],))
        if len(name) == 2 and name[1] == NICK_SUFFIX:
            return Form("nick", (name[0],))
        if len(name) == 1:
            return Form("nick", (name,))
        single = "".join(c for i, c in enumerate(name) if i == 0 or c != name[i - 1])
        return Form("han", (single if len(single) >= 2 else name,), full=True)
    quoted = _QUOTED.search(name)
    nick = fold(quoted.group(1)) if quoted else ""
    if quoted:
        name = name[: quoted.start()] + name[quoted.end() :]
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{first.strip()} {last.strip()}"
    raw = name.split()
    tokens = [fold(t) for t in raw]
    initial = [t.endswith(".") and len(f) == 1 for t, f in zip(raw, tokens, strict=True)]
    if tokens and tokens[0] in COURTESY and len(tokens) > 1:
        return Form("part", (tokens[-1],))
    tokens_ = tuple(t for t in tokens if t)
    if len(tokens_) == 2 and any(initial):
        i = initial.index(True)
        return Form("initial", (tokens_[i], tokens_[1 - i]))
    if len(tokens_) >= 2:
        return Form("words", (" ".join(tokens_[:-1]), tokens_[-1]), full=True, nick=nick)
    if len(tokens_) == 1:
        return Form("part", tokens_)
    return Form("other", (name,))


def _deletions(token: str) -> Iterator[str]:
    yield token
    if len(token) >= 3:
        yield from {token[:i] + token[i + 1 :] for i in range(len(token))}


def keys(form: Form, known: Knowledge) -> tuple[set[str], set[str]]:
    """Blocking keys of a spelling as a variant and as a candidate canonical form."""
    own: set[str] = set()
    if form.kind == "han":
        (c,) = form.parts
        head, given = known.transcribe(c)
        shared = {f"s{c[0]}{''.join(sorted(c[1:]))}", f"t{head}{given}", *(f"w{c[:i]}*{c[i + 1 :]}" for i in range(1, len(c)))}
        own = shared | ({f"g{c}"} if len(c) == 2 else set())
        return own, shared | {f"g{c[1:]}", f"i{head[0]} {given}", *(f"n{x}" for x in c[1:])}
    if form.kind == "given":
        return {f"g{form.parts[0]}", f"n{form.parts[0]}"} if len(form.parts[0]) == 1 else {f"g{form.parts[0]}"}, set()
    if form.kind == "nick":
        return {f"n{form.parts[0]}"}, set()
    if form.kind == "initial":
        return {f"i{form.parts[0]} {form.parts[1]}"}, set()
    if form.kind == "part":
        (t,) = form.parts
        return {f"p{t}", f"t{t}", *(f"k{first}" for first in known.nicks.get(t, ()))}, set()
    if form.kind == "words":
        a, b = form.parts
        shared = {f"d{x}" for t in (a, b) for x in _deletions(t)} | {f"t{a}{b}".replace(" ", ""), f"t{b}{a}".replace(" ", "")}
        own = shared | {f"k{first}" for t in (a, b) for first in known.nicks.get(t, ())}
        return own, shared | {f"i{a[0]} {b}", f"i{b[0]} {a}", f"p{a}", f"p{b}", f"k{a}", f"k{b}"}
    return own, own


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn ``a`` into ``b``, counted up to ``most``."""
    if abs(len(a) - len(b)) >= most:
        return most
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return min(most, rows[-1][-1])


def _typed(a: str, b: str) -> float:
    """Likelihood that one word was typed for another."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 3:
        return 0.0
    d = edits(a, b)
    if min(len(a), len(b)) == 3:
        return 0.01 if d == 1 else 0.0
    return {1: 0.03, 2: 0.004 if min(len(a), len(b)) >= 7 else 0.0}.get(d, 0.0)


def likelihood(x: Form, y: Form, known: Knowledge) -> float:
    """Probability, up to a factor, that a person whose full name is ``y`` is written as ``x``."""
    if y.kind == "han":
        (c,) = y.parts
        head, given = known.transcribe(c)
        if x.kind == "han":
            (v,) = x.parts
            if v == c:
                return 0.5
            if len(v) == len(c) and v[0] == c[0]:
                if sorted(v) == sorted(c):
                    return 0.03
                other = [(p, q) for p, q in zip(c, v, strict=True) if p != q]
                if all(known.read.get(p) == known.read.get(q) or known.alike.get((p, q), 0) + known.alike.get((q, p), 0) > 0 for p, q in other):
                    return 0.03 ** len(other)
            return 0.2 if len(v) == 2 and c[1:] == v else 0.0
        if x.kind == "given":
            return 0.2 if x.parts[0] == c[1:] else 0.0
        if x.kind == "nick":
            return 0.1 if c[-1] == x.parts[0] else 0.02 if x.parts[0] in c[1:] else 0.0
        if x.kind == "initial":
            return 0.05 if x.parts == (head[0], given) else 0.0
        if x.kind in ("words", "part"):
            joined = {"".join(x.parts), "".join(reversed(x.parts))}
            return 0.05 if head + given in {j.replace(" ", "") for j in joined} else 0.0
        return 0.0
    if y.kind != "words":
        return 0.0
    first, last = y.parts
    if x.kind == "words":
        a, b = x.parts
        spelled = not (_spells(a, known) and _spells(b, known))
        best = 0.0
        for p, q, order in ((a, b, 1.0), (b, a, 0.3)):
            straight = (_typed(p, first) * _typed(q, last)) if spelled else float((p, q) == (first, last))
            pet = known.nicks.get(p, {}).get(first, 0) > 0 and _typed(q, last) > 0.02
            best = max(best, order * straight, order * 0.05 * pet)
        return 0.3 * best
    if x.kind == "initial":
        letter, word = x.parts
        return 0.1 if (first[0] == letter and word == last) or (last[0] == letter and word == first) else 0.0
    if x.kind == "part":
        (t,) = x.parts
        count = known.nicks.get(t, {})
        pet = count.get(first, 0) / max(1, sum(count.values()))
        return max(0.1 * (t == first), 0.08 * (t == last), 0.1 * pet, 0.05 * (t in (first + last, last + first)))
    return 0.0


def derived(x: Form, y: Form, known: Knowledge) -> bool:
    """Whether a full form can only be a variant of the other, whatever their frequencies."""
    if y.kind == "han":
        return x.kind == "words" or (x.kind == "han" and len(x.parts[0]) == 2 and y.parts[0][1:] == x.parts[0])
    return x.kind == y.kind == "words" and any(p != y.parts[0] and known.nicks.get(p, {}).get(y.parts[0], 0) > 0 for p in x.parts)


_SYLLABLES: set[str] = set()


def _spells(token: str, known: Knowledge) -> bool:
    """Whether a word is made of transcription syllables: a wrong letter then makes another name."""
    if not _SYLLABLES:
        _SYLLABLES.update(known.read.values())
    reach = {0}
    for i in range(1, len(token) + 1):
        if any(i - n in reach and token[i - n : i] in _SYLLABLES for n in range(1, 7)):
            reach.add(i)
    return len(token) in reach


def _with_titles(names: DataFrame) -> DataFrame:
    """``names`` with the length of the longest known title that each begins with.

    A title is what stands behind a name in brackets or after a dot, anywhere. Beginnings of names are joined with
    them, so that their number has no bound.
    """
    han = r"^([\x{4E00}-\x{9FFF}]+?)(?:[（(]([\x{4E00}-\x{9FFF}]+)[)）]|·([\x{4E00}-\x{9FFF}]+))$"
    titles = names.select(F.concat(F.regexp_extract("name", han, 2), F.regexp_extract("name", han, 3)).alias("begin")).filter("begin <> ''").distinct()
    bare = names.select("id", F.when(F.regexp_extract("name", han, 1) != "", F.regexp_extract("name", han, 1)).otherwise(F.regexp_replace("name", r"\s+", " ")).alias("bare"))
    bare = bare.filter(F.col("bare").rlike(r"^[\x{4E00}-\x{9FFF}]{3,}$"))
    begins = bare.select("id", F.explode(F.expr("transform(sequence(1, length(bare) - 2), n -> substring(bare, 1, n))")).alias("begin"))
    longest = begins.join(titles, "begin").groupBy("id").agg(F.max(F.length("begin")).alias("title"))
    return names.join(longest, "id", "left").withColumn("title", F.coalesce("title", F.lit(0)))


def _bounded(rows: DataFrame, what: str) -> list:
    found = rows.limit(MOST_LEARNED + 1).collect()
    if len(found) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} {what} were learned")
    return found


def _learn(names: DataFrame, read: dict[str, str]) -> Knowledge:
    """Look-alike characters and nicknames from all spellings of all books."""
    known = Knowledge(read)

    def parts(batches):
        for batch in batches:
            rows = []
            for book, name, n, title in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                form = parse(name, known, title)
                if form.kind == "han" and len(form.parts[0]) >= 2:
                    c = form.parts[0]
                    rows += [(book, f"w{c[:i]}*{c[i + 1 :]}", c[i], n, "") for i in range(1, len(c))]
                elif form.kind == "words":
                    first, last = form.parts
                    rows.append((book, f"l{last}", first, n, form.nick))
                elif form.kind == "part":
                    rows.append((book, "p", form.parts[0], n, ""))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["book_id", "key", "what", "n", "nick"])

    seen = names.select("book_id", "name", "n", "title").mapInArrow(parts, "book_id bigint, key string, what string, n bigint, nick string")
    seen = materialize(seen.groupBy("book_id", "key", "what", "nick").agg(F.sum("n").alias("n")), "parts")
    left, right = (seen.groupBy("book_id", "key", "what").agg(F.sum("n").alias("n")).select("book_id", "key", F.col("what").alias(w), F.col("n").alias(f"n{w}")) for w in "xy")
    both = left.filter("key <> 'p'").join(right, ["book_id", "key"]).filter("x <> y and nx >= ny")
    # A pair of characters that takes each other's place in several books is a likeness; relatives' names vary freely.
    pairs = both.filter("key like 'w%'").groupBy("x", "y").agg(F.countDistinct("book_id", "key").alias("n")).filter("n >= 2")
    for r in _bounded(pairs, "look-alike pairs"):
        known.alike[r.x, r.y] = r.n
    quoted = seen.filter("nick <> ''").groupBy(F.col("what").alias("first"), "nick").agg(F.countDistinct("book_id").alias("n"))
    # "Nick Last" beside "First Last", where the short name begins like or ends like the long one, is weaker evidence.
    # The two parts of a name keep their order: other words before one surname are relatives.
    short = both.filter("key like 'l%' and length(y) < length(x)").groupBy(F.col("x").alias("first"), F.col("y").alias("nick")).agg(F.countDistinct("book_id").alias("n"))
    short = short.filter("n >= 2")
    # A word that stands alone and is always in the company of one first name that isn't common stands for it.
    alone, firsts = seen.filter("key = 'p'").select("book_id", F.col("what").alias("nick")).distinct(), seen.filter("key like 'l%'").select("book_id", F.col("what").alias("first")).distinct()
    alone = alone.join(firsts, [alone.book_id == firsts.book_id, alone.nick == firsts["first"]], "left_anti")
    books = alone.groupBy("nick").agg(F.count("*").alias("books")).filter("books >= 3")
    total = max(1, firsts.select("book_id").distinct().count())
    usual = firsts.groupBy("first").agg((F.count("*") / F.lit(total)).alias("usual"))
    # A first name that is in nine tenths of a word's books is in any tenth of them and one more: those with the fewest
    # names are looked at, so that no large book's words meet all its names.
    alone = alone.join(books, "nick").join(firsts.groupBy("book_id").agg(F.count("*").alias("names")), "book_id")
    place = F.row_number().over(Window.partitionBy("nick").orderBy("names", "book_id"))
    probes = alone.withColumn("place", place).filter("place <= floor(books * 0.1 + 0.0000001) + 1").select("nick", "books", "book_id")
    likely = probes.join(firsts, "book_id").join(usual, "first").filter("pow(usual, books) < 0.01").select("nick", "first", "books").distinct()
    company = likely.join(alone.select("nick", "book_id"), "nick").join(firsts, ["book_id", "first"]).groupBy("nick", "first", "books").agg(F.count("*").alias("n"))
    company = company.filter("n >= 0.9 * books").select("first", "nick", "n")
    nicks = quoted.unionByName(short).unionByName(company).groupBy("first", "nick").agg(F.sum("n").alias("n"))
    for r in _bounded(nicks, "nicknames"):
        known.nicks.setdefault(r.nick, {})[r.first] = r.n
    release(seen)
    return known


def spellings(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(book_id, name, n): the distinct spellings of both tables in plain form, without words for anybody."""
    alias = candidates.select("book_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    raw = entries.select("book_id", F.col("heroine_name").alias("name")).unionByName(alias).filter("book_id is not null and name is not null")
    # Counted before the plain form is taken: the Python side sees each raw spelling of a book once.
    counted = raw.groupBy("book_id", "name").agg(F.count("*").alias("n"))
    plain = with_plain_form(counted, "name", "plain").groupBy("book_id", F.col("plain").alias("name")).agg(F.sum("n").alias("n"))
    return plain.filter(F.col("name").rlike(r"\p{L}") & ~F.trim("name").isin(*ANYBODY)).withColumn("id", F.xxhash64("book_id", "name"))


def persons(names: DataFrame) -> DataFrame:
    """(book_id, name, person): every spelling that is linked with another one."""
    plain = materialize(names, "plain")
    names = materialize(_with_titles(plain), "names")
    release(plain)
    known = _learn(names, readings(names.sparkSession))
    shared = names.sparkSession.sparkContext.broadcast(known)

    def block(batches):
        for batch in batches:
            rows, at = [], []
            for i, (name, title) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                form = parse(name, shared.value, title)
                variant, candidate = keys(form, shared.value)
                for k in variant | candidate:
                    rows.append((k, k in variant, form.full and k in candidate))
                    at.append(i)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            taken = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.bool_()), strict=True))], ["book_id", "id", "name", "n", "title", "key", "variant", "candidate"])

    fields = "book_id bigint, id bigint, name string, n bigint, title int"
    keyed = materialize(names.select("book_id", "id", "name", "n", "title").mapInArrow(block, f"{fields}, key string, variant boolean, candidate boolean"), "keyed")
    x = keyed.filter("variant").select("book_id", "key", F.col("id").alias("x"), F.col("name").alias("xname"), F.col("n").alias("xn"), F.col("title").alias("xtitle"))
    y = keyed.filter("candidate").select("book_id", "key", F.col("id").alias("y"), F.col("name").alias("yname"), F.col("n").alias("yn"), F.col("title").alias("ytitle"))
    pairs = x.join(y, ["book_id", "key"]).filter("x <> y").drop("key").distinct()

    def weigh(batches):
        for batch in batches:
            full, weight, free = [], [], []
            for a, b, s, t in zip(*(batch.column(i).to_pylist() for i in (1, 3, 6, 7)), strict=True):
                form, other = parse(a, shared.value, s), parse(b, shared.value, t)
                full.append(form.full)
                weight.append(likelihood(form, other, shared.value))
                free.append(form.full and derived(form, other, shared.value))
            keep = pa.array([w > 0 for w in weight])
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), batch.column(5), pa.array(full), pa.array(weight, pa.float64()), pa.array(free, pa.bool_())], ["x", "y", "xn", "yn", "full", "weight", "free"])
            yield rows.filter(keep)

    weighed = pairs.select("x", "xname", "y", "yname", "xn", "yn", "xtitle", "ytitle").mapInArrow(weigh, "x bigint, y bigint, xn bigint, yn bigint, full boolean, weight double, free boolean")
    weighed = materialize(weighed.withColumn("posterior", F.col("weight") * F.col("yn")), "weighed")
    # A full name goes to a more frequent one (or, at equal counts, to the larger id), unless only it can be the variant.
    better = F.struct("yn", "y") > F.struct("xn", "x")
    first = weighed.filter("full").filter(F.col("free") | better).groupBy("x").agg(F.max_by("y", F.struct("posterior", "y")).alias("y"))
    roots = connected_components(first, "x", "y")
    roots = materialize(roots.select(F.col("node").alias("y"), "component"), "roots")
    rest = weighed.filter("not full").join(roots, "y", "left").withColumn("root", F.coalesce("component", "y"))
    by_person = rest.groupBy("x", "root").agg(F.sum("posterior").alias("posterior"))
    best = by_person.groupBy("x").agg(F.max_by("root", F.struct("posterior", "root")).alias("root"), F.max("posterior").alias("most"), F.sum("posterior").alias("all"))
    second = best.filter(F.col("most") >= CERTAIN * F.col("all")).select("x", F.col("root").alias("y"))
    linked = connected_components(first.unionByName(second), "x", "y")
    found = names.join(linked.select(F.col("node").alias("id"), F.col("component").alias("person")), "id").select("book_id", "name", "person")
    found = materialize(found, "persons")
    release(names, keyed, weighed, roots)
    return found


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of each person, smaller string first."""
    left, right = (linked.select("book_id", "person", F.col("name").alias(f"name_{s}")) for s in "ab")
    return left.join(right, ["book_id", "person"]).filter("name_a < name_b").select("book_id", "name_a", "name_b")


