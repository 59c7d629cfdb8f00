"""Variant spellings of names: linking those that mean the same person or organisation.

Each spelling is read into a form: tokens without accents, case and titles; the parts of a person's name in the order given, middle,
surname; the words of an organisation with its abbreviations undone. Spellings of one form are the same name. Forms are linked
  - by a symmetric-delete neighbourhood index on tokens: a token with one character deleted, keyed by the form's other
    tokens, meets every token at one edit (also a lost space: neighbouring tokens are indexed joined); the meeting is then verified;
  - by aligning tokens where a form has initials, abbreviations or short given names: an optimal assignment of the tokens of two forms of
    the same surname and number of tokens in which initials match names they begin and abbreviations their full forms;
  - by leaving out middle names: a name whose given names are some of a longer one's, the first among them, in the same order;
  - by one edit in the given name or surname of a name that is also shortened (initials, or middle names left out), by the same kind of index;
  - by acronym, for organisations.
A form whose initials fit several names is linked to the one that has most of the records that fit, if it has most of them; a form
without middle names likewise, where those of its own records count against the link that write it out plainly ("Given Surname"): a
name of its own is written so, a shortened one also in derived ways only (inverted, titled, upper case, a nickname, an initial).
An edit is no link where both tokens are established: the rarer isn't rare beside the other, and chance alone would bring it together with the rest of the name.
Links of forms are closed to components by label propagation; every step is a join on keys, and spellings, not rows, are joined.

Defined results: null and blank names and elements that hold several names are left out; spellings are compared exactly, without white
space at their ends; repeated rows count once a spelling; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.packed import Grammar
from quirework.runtime import checkpointed

LEXICON_BOUND = 500_000  # given names that are shipped to the workers; more are an error
RARE, CHANCE, PRIOR = 0.05, 0.1, 100  # see _typing_links; PRIOR forms are added to all, as chance can't be told from a handful

TITLES = frozenset("dr prof mr mrs ms miss sir dame rev fr st saint lady lord".split())
PARTICLES = frozenset("van de von der den del della di da la le du ten ter af av zu".split())
LEGAL = frozenset("ltd inc llc gmbh plc ag limited incorporated".split())
CONNECTORS = frozenset("of for the and & + et und y".split())
# Words of organisations' names: each line is one word with its abbreviations, the first being the one kept.
_ORGANISATION = """
press pr
editions eds edition editors
publishers publisher publishing publ pubs pub publs
house hse
brothers bros
books bks bk
company co comp
group grp
media med
verlag vlg verl
society soc
foundation found fdn fndn
institute inst
library lib libr
collective coll collect
university univ u
printing prtg print printg
studies stud
street str
"""
ORGANISATION = {w: line.split()[0] for line in _ORGANISATION.strip().splitlines() for w in line.split()}
#: words that by themselves tell an organisation; the short abbreviations only count beside another one or with a full stop
TELLING = frozenset(w for w in ORGANISATION if len(w) > 4 and w not in ("media", "house", "print", "street", "found", "group", "studies")) | frozenset("eds bks bros press prtg".split())
_LONG = sorted(w for w in ORGANISATION if len(w) > 4)

_PIECE = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?|[&+]|\d+")
_INITIALS = re.compile(r"(?:[^\W\d_]\.\s?-?){2,}$|[^\W\d_]\.?$")


def folded(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return plain.translate(str.maketrans({"ø": "o", "ł": "l", "ı": "i", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"}))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or transposition of neighbours turns one string into the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _known_word(token: str) -> str | None:
    """The organisation word a token is, also with one typing error in a long one."""
    word = ORGANISATION.get(token)
    if word or len(token) < 5:
        return word
    return next((ORGANISATION[w] for w in _LONG if one_edit(token, w)), None)


def _pieces(text: str) -> list[str]:
    """Tokens of a folded name; runs of initials written together are taken apart."""
    out = []
    for token in re.split(r"[\s,;]+", re.sub(r"([&+])", r" \1 ", text)):
        if re.fullmatch(r"(?:[^\W\d_]\.-?){2,}[^\W\d_]?", token):
            out += [c + "." for c in re.findall(r"[^\W\d_]", token)]
        elif token:
            out.append(token)
    return out


def is_organisation(text: str) -> bool:
    tokens = [t.strip(".") for t in _pieces(folded(text))]
    return any(t in TELLING or len(t) > 5 and (w := _known_word(t)) and w in ("editions", "publishers", "brothers", "society", "foundation", "institute", "library", "collective", "university", "printing", "company", "verlag", "books", "press") for t in tokens)


def organisation_form(text: str) -> list[str]:
    low = folded(text)
    head, comma, tail = low.partition(",")
    if comma and tail.strip(" .") not in LEGAL and any(_known_word(t.strip(".")) for t in _pieces(head)) and not any(_known_word(t.strip(".")) for t in _pieces(tail)):
        low = f"{tail} {head}"  # Institute of Tides, Harbour -> Harbour Institute of Tides
    out = []
    for token in _pieces(low):
        word = token.strip(".’'\"()")
        if not word or word in LEGAL or word in CONNECTORS:
            continue
        if word == "up" and out:
            out += ["university", "press"]
            continue
        out.append(_known_word(word) or word)
    return out


def person_form(text: str, given: frozenset[str], short: dict[str, str]) -> list[str]:
    """Tokens of a person's name in the order given names, surname; initials and abbreviations keep a full stop."""
    low = folded(text)
    left, comma, right = low.partition(",")
    tokens = [t for t in _pieces(right if comma else low) if t.strip(".") not in TITLES]

    def clean(t: str) -> str:
        core = t.strip(".’'\"()").replace("-", "")
        if len(core) == 1:
            return core + "."
        return core + ("." if t.endswith(".") else "")

    tokens = [clean(t) for t in tokens if t.strip(".’'\"()&+")]
    if comma:
        surname = [clean(t).strip(".") for t in _pieces(left) if t.strip(".") not in TITLES]
        while tokens and tokens[-1].strip(".") in PARTICLES and len(tokens) > 1:
            surname.insert(0, tokens.pop())
        names = tokens
    elif len(tokens) < 2:
        names, surname = [], tokens
    else:
        last = tokens[-1].strip(".")
        first = tokens[0].strip(".")
        if len(last) == 1 and len(first) > 1:  # Surname G
            at = next(i for i, t in enumerate(tokens) if len(t.strip(".")) == 1)
            names, surname = tokens[at:], tokens[:at]
        elif first not in given and len(first) > 1 and not tokens[0].endswith(".") and (last in given or len(tokens) > 2 and tokens[1] in given):  # Surname Given
            at = next(i for i, t in enumerate(tokens) if t in given)
            names, surname = tokens[at:], tokens[:at]
        else:
            at = len(tokens) - 1
            while at > 1 and tokens[at - 1] in PARTICLES:
                at -= 1
            names, surname = tokens[:at], tokens[at:]
    if names and names[0] in short:  # known short forms
        names = [short[names[0]], *names[1:]]
    return [*names, "_".join(t.strip(".").replace("-", "") for t in surname)] if surname else names


def form(text: str, kind: str, given: frozenset[str], short: dict[str, str]) -> tuple[str, str, bool]:
    """(kind, form, complete) of a spelling; kind is ``org``, ``acronym`` or ``person``."""
    bare = text.strip()
    if re.fullmatch(r"[A-ZÀ-Þ]{2,6}", bare) and (kind == "org" or len(bare) < 6):
        return "acronym", folded(bare), False
    if kind == "org" or is_organisation(bare):
        return "org", " ".join(organisation_form(bare)), True
    tokens = person_form(bare, given, short)
    return "person", " ".join(tokens), not any(t.endswith(".") for t in tokens)


def assignment(a: list[str], b: list[str]) -> float | None:
    """Least total cost of pairing the given-name tokens of two names, None if they can't all be paired.

    Equal tokens cost 0, an initial or an abbreviation with a name that it begins 1, two initials 0; order costs 0.25 a moved token.
    """
    if len(a) != len(b):
        return None

    def cost(x: str, y: str) -> float | None:
        p, q = x.strip("."), y.strip(".")
        if p == q:
            return 0.0
        if x.endswith(".") and q.startswith(p) or y.endswith(".") and p.startswith(q):
            return 1.0
        return None

    best: dict[int, float] = {0: 0.0}  # set of used tokens of b -> cost; names have a handful of tokens
    for i, x in enumerate(a):
        following: dict[int, float] = {}
        for used, total in best.items():
            for j, y in enumerate(b):
                if not used >> j & 1 and (c := cost(x, y)) is not None:
                    key, sum_ = used | 1 << j, total + c + (0.25 if i != j else 0)
                    if sum_ < following.get(key, 1e9):
                        following[key] = sum_
        best = following
    return best.get((1 << len(b)) - 1)


def without_middle(a: list[str], b: list[str]) -> bool:
    """Whether given names ``a`` are those of ``b`` without one or more middle names: the first ones agree, the others stand in ``b`` in the same order."""
    if not 0 < len(a) < len(b) or assignment(a[:1], b[:1]) is None:
        return False
    rest = iter(b[1:])
    return all(any(assignment([x], [y]) is not None for y in rest) for x in a[1:])


def deletions(tokens: list[str]) -> list[tuple[str, str]]:
    """(key, token) of the symmetric-delete index: other tokens with their places, and the token with at most one character deleted."""
    out = set()
    for i in range(len(tokens)):
        for j in (i + 1, i + 2):
            if j > len(tokens):
                continue
            token = "".join(tokens[i:j])
            if len(token) < 4 or token.endswith("."):
                continue
            context = f"{' '.join(tokens[:i])}*{' '.join(tokens[j:])}"
            if context == "*":
                continue
            out.add((f"{context}#{token}", token))
            out.update((f"{context}#{token[:k]}{token[k + 1 :]}", token) for k in range(len(token)))
    return sorted(out)


def spellings(frame: DataFrame, people: list[str], organisations: list[str]) -> DataFrame:
    """(spelling, kind, n): distinct single names of the array columns ``people`` and the columns ``organisations``.

    Strings are counted before they are parsed, so each distinct one is parsed once.
    """
    parts = [frame.select(F.explode(f"`{c}`").alias("s"), F.lit("any").alias("kind")) for c in people]
    parts += [frame.select(F.col(f"`{c}`").alias("s"), F.lit("org").alias("kind")) for c in organisations]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    raw = out.where("s IS NOT NULL").groupBy("s", "kind").agg(F.count("*").alias("n"))

    @F.pandas_udf("string")
    def single(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grammar = Grammar((), people=True)
        for s, kind in batches:
            yield pd.Series([t.strip() if t.strip() and (k == "org" or len(grammar.parse(t)[0]) == 1) else None for t, k in zip(s, kind)])

    named = raw.select(single("s", "kind").alias("spelling"), "kind", "n").where("spelling IS NOT NULL")
    return named.groupBy("spelling").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))  # org where it is one anywhere


def given_names(names: DataFrame, short: DataFrame | None = None, least: int = 5) -> frozenset[str]:
    """Given names of the corpus: tokens that stand first, or behind a comma, beside many surnames and seldom as one."""

    @F.pandas_udf("struct<g string, s string>")
    def ends(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            left, comma, right = folded(t).partition(",")
            a, b = _pieces(right if comma else left), _pieces(left)
            a = [x for x in a if x.strip(".") not in TITLES]
            out.append((a[0] if a and len(a[0]) > 2 and not a[0].endswith(".") else None, b[-1] if b and len(b[-1]) > 2 and (comma or len(b) > 1) else None))
        return pd.DataFrame(out, columns=["g", "s"])

    both = names.where("kind <> 'org'").select(ends("spelling").alias("e"))
    counts = both.select(F.explode(F.array(F.struct(F.col("e.g").alias("t"), F.col("e.s").alias("o"), F.lit(1).alias("f")), F.struct(F.col("e.s").alias("t"), F.col("e.g").alias("o"), F.lit(0).alias("f")))).alias("x"))
    scored = counts.where("x.t IS NOT NULL").groupBy("x.t").agg(F.sum("x.f").alias("first"), F.sum(1 - F.col("x.f")).alias("last"))
    rows = scored.where(f"first >= {least} AND first >= 3 * last").select("t").limit(LEXICON_BOUND + 1).collect()
    if len(rows) > LEXICON_BOUND:
        raise ValueError("more given names than LEXICON_BOUND")
    return frozenset(r.t.replace("-", "") for r in rows) - PARTICLES


def is_plain(text: str, tokens: list[str]) -> bool:
    """Whether a person's name is written out plainly: given names and surname in this order, capitalised, without title, initial or short form."""
    own = text.split(" ")
    return len(own) > 1 and "," not in text and all(t[:1].isupper() and not t.isupper() or folded(t) in PARTICLES for t in own) and folded(own[0]).replace("-", "") == tokens[0] and not any(t.endswith(".") for t in own)


def forms(names: DataFrame, given: frozenset[str], short: dict[str, str]) -> DataFrame:
    """(spelling, n, kind, form, complete, plain) of every spelling."""

    @F.pandas_udf("kind string, form string, complete boolean, plain boolean")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for s, kind in batches:
            rows = [form(t, k, given, short) for t, k in zip(s, kind)]
            yield pd.DataFrame([(*r, r[0] == "person" and r[2] and is_plain(t, r[1].split(" "))) for t, r in zip(s, rows)], columns=["kind", "form", "complete", "plain"])

    return names.select("spelling", "n", read("spelling", "kind").alias("f")).select("spelling", "n", "f.*").where("form <> ''")


def _typing_links(nodes: DataFrame) -> DataFrame:
    """(a, b): ids of forms of one kind that differ by one edit in one token, unless both tokens are established ones.

    They are where the rarer token has at least ``RARE`` of the other's forms, and the number of forms in which chance would bring it together with the
    other tokens (forms with it x forms with them / all forms) is at least ``CHANCE``; both are ratios, so the rule is the same at every size.
    """

    @F.pandas_udf("array<struct<key string, token string>>")
    def index(form_: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "token": t} for k, t in deletions(f.split(" "))] for f in form_])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) or x == y for x, y in zip(a, b)], dtype=bool)

    named = nodes.where("kind <> 'acronym'")
    tokens = named.select("kind", "form", F.explode(F.array_distinct(F.split("form", " "))).alias("token")).groupBy("kind", "token").agg(F.count("*").alias("df"))
    keyed = named.select("id", "kind", F.explode(index("form")).alias("x")).select("id", "kind", "x.key", "x.token", F.substring_index("x.key", "#", 1).alias("context"))
    around = keyed.where("key = concat(context, '#', token)").groupBy("kind", "context").agg(F.count("*").alias("dc"))
    met = keyed.select("kind", "key", "context", F.col("id").alias("a"), F.col("token").alias("ta")).join(keyed.select("kind", "key", F.col("id").alias("b"), F.col("token").alias("tb")), ["kind", "key"])
    met = checkpointed(met.where("a < b").select("kind", "a", "b", "ta", "tb", "context").distinct().where(near("ta", "tb")))
    of = lambda c, n: tokens.select("kind", F.col("token").alias(c), F.col("df").alias(n))
    met = met.join(of("ta", "da"), ["kind", "ta"], "left").join(of("tb", "db"), ["kind", "tb"], "left").join(around, ["kind", "context"], "left")
    met = met.join(F.broadcast(nodes.groupBy("kind").agg((CHANCE * (F.count("*") + PRIOR)).alias("enough"))), "kind")  # one row a kind
    few, many = F.least(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))), F.greatest(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0)))
    return met.where((few < RARE * many) | (few * F.coalesce("dc", F.lit(0)) < F.col("enough"))).select("a", "b")


def _settled(fits: DataFrame) -> DataFrame:
    """(a, b): for each incomplete form one of the names (groups g of forms) that fit, if it has most of the records of all of them."""
    each = fits.groupBy("a", "g").agg(F.min("b").alias("b"), F.sum("n").alias("n"))
    best = each.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.where("most > 0.5 * all").select("a", "b")


def _initial_links(nodes: DataFrame) -> DataFrame:
    """(a, b): person forms with initials or abbreviations, and the complete form each stands for."""
    parts = nodes.where("kind = 'person' AND form LIKE '% %'").select("form", "g", "n", "complete", F.element_at(F.split("form", " "), -1).alias("surname"), F.size(F.split("form", " ")).alias("k"), F.substring("form", 1, 1).alias("i"))
    left = parts.where("NOT complete").select(F.col("form").alias("a"), "surname", "k", "i")
    # names written out count; ones abbreviated to more than a letter only decide where none is written out
    right = parts.where(~F.col("form").rlike(r"(^| )[^ ]\.")).select(F.col("form").alias("b"), "g", F.when(F.col("complete"), F.col("n") * 1000).otherwise(F.col("n")).alias("n"), "surname", "k", "i")

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([assignment(x.split(" ")[:-1], y.split(" ")[:-1]) for x, y in zip(a, b)], dtype="float64")

    return _settled(left.join(right, ["surname", "k", "i"]).withColumn("cost", cost("a", "b")).where("cost IS NOT NULL AND a <> b").select("a", "b", "g", "n"))


def shortened(a: list[str], b: list[str]) -> bool:
    """Whether name ``a`` is name ``b`` with one edit in the given name or the surname, and shortened: by initials or by leaving out middle names."""
    if len(a) < 2 or len(b) < len(a) or len(a) == len(b) and not any(t.endswith(".") for t in a):
        return False
    if a[-1] == b[-1]:
        if a[0].endswith(".") or min(len(a[0]), len(b[0])) < 4 or not one_edit(a[0], b[0]):
            return False
    elif min(len(a[-1]), len(b[-1])) < 5 or not one_edit(a[-1], b[-1]) or assignment(a[:1], b[:1]) is None:
        return False
    rest = iter(b[1:-1])
    return all(any(assignment([x], [y]) is not None for y in rest) for x in a[1:-1])


def edit_keys(tokens: list[str], left: bool) -> list[str]:
    """Keys under which a shortened name with an edit (``left``) and a written-out one meet: given name and surname, one of them with at most one character deleted."""
    first, last = tokens[0], tokens[-1]
    cut = lambda t: {t, *(t[:k] + t[k + 1 :] for k in range(len(t)))}
    out = {f"i {first[0]} {x}" for x in cut(last)} if len(last) > 4 and (first.endswith(".") or not left) else set()
    if not first.endswith("."):
        out |= {f"f {first} {x}" for x in cut(last)} if len(last) > 4 else set()
        out |= {f"g {x} {last}" for x in cut(first)} if len(first) > 3 else set()
    return sorted(out)


def _middle_links(nodes: DataFrame) -> DataFrame:
    """(a, b): person forms that are shortened, and a form of the longer name that has most of the records of all longer ones that fit.

    ``g`` is the group of a form by all other links. Records of the group that write the short name out plainly count against leaving out middle names;
    with an edit, the group must not have more records than the longer name. A form with initials is left to its group if that holds a name written out.
    """
    groups = nodes.where("kind = 'person'").groupBy("g").agg(F.sum("n_plain").alias("own"), F.sum("n").alias("n_all"), F.max("complete").alias("written"))
    parts = nodes.where("kind = 'person' AND form LIKE '% %'").select("form", "g", "n", "complete", F.element_at(F.split("form", " "), -1).alias("surname"), F.size(F.split("form", " ")).alias("k"), F.substring("form", 1, 1).alias("i"))
    left = parts.join(groups, "g").where("complete OR NOT written").select(F.col("form").alias("a"), F.col("g").alias("ga"), "own", "n_all", "surname", F.col("k").alias("ka"), "i", "complete")
    right = parts.where("k > 2").select(F.col("form").alias("b"), F.col("g").alias("gb"), "n", "surname", F.col("k").alias("kb"), "i")

    @F.pandas_udf("boolean")
    def fits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([without_middle(x.split(" ")[:-1], y.split(" ")[:-1]) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("boolean")
    def edited(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shortened(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("array<string>")
    def keys(form_: pd.Series, short_: pd.Series) -> pd.Series:
        return pd.Series([edit_keys(f.split(" "), bool(x)) for f, x in zip(form_, short_)])

    met = left.join(right, ["surname", "i"]).where("ka < kb AND ga <> gb").where(fits("a", "b")).select("a", "ga", F.col("own").alias("against"), "gb", "b", "n", F.lit(0).alias("edits"))
    some = left.where("ka = 2 OR NOT complete").select("a", "ga", "n_all", "ka", F.explode(keys("a", F.lit(True))).alias("key"))
    whole = parts.where("complete").select(F.col("form").alias("b"), F.col("g").alias("gb"), "n", F.explode(keys("form", F.lit(False))).alias("key"))
    near = some.join(whole, "key").where("ga <> gb").select("a", "ga", "n_all", "gb", "b", "n").distinct().where(edited("a", "b"))
    met = checkpointed(met.unionByName(near.select("a", "ga", F.col("n_all").alias("against"), "gb", "b", "n", F.lit(1).alias("edits"))))
    each = met.groupBy("ga", "gb", "b").agg(F.max("n").alias("n"), F.min(F.struct("edits", "against")).alias("x")).groupBy("ga", "gb").agg(F.min("b").alias("b"), F.sum("n").alias("n"), F.min("x").alias("x"))
    # names that fit without an edit come before those that need one
    least = each.groupBy("ga").agg(F.min("x.edits").alias("edits"))
    each = each.join(least, "ga").where("x.edits = edits").select("ga", "gb", "b", "n", "edits", F.col("x.against").alias("against"))
    best = each.groupBy("ga").agg(F.max_by("b", F.struct("n", "b")).alias("b"), F.max("n").alias("most"), F.sum("n").alias("all"), F.max("against").alias("against"), F.max("edits").alias("edits"))
    best = best.where("most > 0.5 * all AND CASE WHEN edits = 0 THEN most > 0.5 * (all + against) ELSE most >= against END").select("ga", "b")
    return met.select("a", "ga").distinct().join(best, "ga").select("a", "b")


def _acronym_links(nodes: DataFrame) -> DataFrame:
    """(a, b): acronyms and the organisation whose words begin with their letters."""
    full = nodes.where("kind = 'org' AND form LIKE '% %'").select(F.col("form").alias("b"), "g", "n", F.array_join(F.transform(F.split("form", " "), lambda w: F.substring(w, 1, 1)), "").alias("a"))
    return _settled(nodes.where("kind = 'acronym'").select(F.col("form").alias("a")).join(full, "a").select("a", "b", "g", "n"))


def _order_links(nodes: DataFrame) -> DataFrame:
    """(a, b): organisations of the same words in another order."""
    words = nodes.where("kind = 'org'").select("form", F.array_join(F.array_sort(F.split("form", " ")), " ").alias("words"))
    first = words.groupBy("words").agg(F.min("form").alias("b"))
    return words.join(first, "words").where("form <> b").select(F.col("form").alias("a"), "b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of every node's component, by label propagation with path shortening; an error if ``rounds`` aren't enough.

    Shortening halves the way to the smallest node in a round, so 60 rounds are more than any graph needs that can be stored.
    """
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("l")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        jump = labels.select(F.col("node").alias("l"), F.col("l").alias("j"))
        new = labels.join(near, "node").withColumn("l2", F.least("l", "m")).join(jump, "l").select("node", F.least("l2", "j").alias("l"), (F.least("l2", "j") < F.col("l")).alias("changed"))
        labels = checkpointed(new)
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("l").alias("component"))
        labels = labels.drop("changed")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their groups ``g`` joined along links of node ids; only groups that a link touches are looked at."""
    of = nodes.select("id", "g")
    ends = links.join(of.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    parts = components(ends).select(F.col("node").alias("g"), "component")
    return checkpointed(nodes.join(parts, "g", "left").withColumn("g", F.coalesce("component", "g")).drop("component"))


def linked(frame: DataFrame, people: list[str], organisations: list[str], short_forms: DataFrame) -> DataFrame:
    """(spelling, n, kind, entity): every single-name spelling with its entity (the smallest form of the component)."""
    names = checkpointed(spellings(frame, people, organisations))
    rows = short_forms.select("given", "short_form").where("given IS NOT NULL AND short_form IS NOT NULL").limit(LEXICON_BOUND + 1).collect()
    if len(rows) > LEXICON_BOUND:
        raise ValueError("more short forms than LEXICON_BOUND")
    short: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.short_form, r.given)):
        short.setdefault(folded(r.short_form), folded(r.given))
    given = given_names(names) | frozenset(short) | frozenset(short.values())
    read = checkpointed(forms(names, given, short))
    nodes = read.groupBy("kind", "form").agg(F.sum("n").alias("n"), F.max("complete").alias("complete"), F.sum(F.when(F.col("plain"), F.col("n")).otherwise(0)).alias("n_plain"))
    nodes = nodes.withColumn("id", F.concat_ws(" ", "kind", "form")).withColumn("g", F.col("id"))
    tagged = lambda links, ka, kb: links.select(F.concat_ws(" ", F.lit(ka), "a").alias("a"), F.concat_ws(" ", F.lit(kb), "b").alias("b"))
    nodes = checkpointed(nodes)
    nodes = _merged(nodes, _typing_links(nodes).unionByName(tagged(_order_links(nodes), "org", "org")))
    nodes = _merged(nodes, tagged(_initial_links(nodes), "person", "person").unionByName(tagged(_acronym_links(nodes), "acronym", "org")))
    nodes = _merged(nodes, tagged(_middle_links(nodes), "person", "person"))
    return read.join(nodes.select("kind", "form", "g"), ["kind", "form"]).select("spelling", "n", "kind", F.col("g").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """(spelling_a, spelling_b), spelling_a < spelling_b by code points, of spellings of one entity: the expansion of ``linked``, which has one row a spelling."""
    a = entities.select("entity", F.col("spelling").alias("spelling_a"))
    b = entities.select("entity", F.col("spelling").alias("spelling_b"))
    return a.join(b, "entity").where("spelling_a < spelling_b").select("spelling_a", "spelling_b")
