"""Problem 2: spellings of names that stand for the same person or outlet.

Distinct spellings are compared, not rows. Each becomes a vector of character trigrams weighted by their inverse
document frequency. A person's trigrams carry the initial of the other part of the name (of the surname those of the
given name, and the other way round): order and initials then tell nothing apart, a slip of the keys spoils one half at
most, and postings are many times shorter. A sparse similarity join finds all pairs whose cosine reaches MIN_COSINE:
both sides are indexed under their rarest trigrams only, as many as keep any such pair from slipping through (prefix
filtering). Pairs are then compared part by part
(slips, initials, short forms, order). What remains is a sparse graph; its components are grouped by average-linkage
clustering, with spellings weighted by how often they occur. Short spellings join afterwards, and only where one group
fits them. A component too large for a task is clustered by all of its links too, in rounds over tables.
"""

from __future__ import annotations

import heapq
import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.known import one_slip
from newsloom.llm.values import is_stand_in
from newsloom.session import stage, unstage

MIN_COSINE, MIN_LINK, LONE_LINK = 0.35, 0.25, 0.8
MAX_COMPONENT, STRONGER = 50_000, (0.4, 0.55, 0.7, 0.8, 0.9)  # names in one task, and the links of `bounded_components`
WORTH = 20  # rounds over tables go on while they merge one in so many groups
FLOOR = 8  # a trigram met only in one misspelling weighs no more than one met in so many names

# Words of bylines that name a desk or nobody in particular.
DESK_WORDS = frozenset(
    "staff newsroom desk services service reporter reporters editor editors editorial correspondent correspondents contributor contributors "
    "agency agencies team wire wires admin administrator guest anonymous unknown author various news bureau newsdesk writer writers".split()
)
# What is put before or after the name of a person or outlet.
_BY = regex.compile(r"^\s*(?:by|von|par|por|written by)[\s:]+", regex.I)
_THE = regex.compile(r"^\s*the\s+", regex.I)
_COMPANY = regex.compile(r"[\s,]+(?:ltd|limited|inc|incorporated|llc|plc|corp|corporation|co|gmbh|sa|ag|online|\.com)\.?\s*$", regex.I)
_BRACKETS = regex.compile(r"\s*[\[(][^\])]*[\])]\s*$")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_PART = regex.compile(r"[\p{L}\p{N}]+\.?")
# Short forms of given names.
SHORT_FORMS = {
    "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave", "deborah": "deb debbie debby", "edward": "ed eddie ted ned", "elizabeth": "liz lizzie beth betty eliza", "frederick": "fred freddie freddy",
    "gregory": "greg", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "katherine": "kate kathy katie kat",
    "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat patty trish", "patrick": "pat paddy",
    "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "thomas": "tom tommy",
    "timothy": "tim", "victoria": "vicky vicki tori", "william": "bill billy will willy liam", "zachary": "zach",
}
_FORMAL = {s: f for f, forms in reversed(SHORT_FORMS.items()) for s in forms.split()}
_SHORT = {(f, s) for f, forms in SHORT_FORMS.items() for s in forms.split()}


def plain(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t.replace("ø", "o").replace("đ", "d").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")


def parts_of(kind: str, name: str) -> list[str]:
    """A name's parts in reading order, a dot kept on shortened ones; empty for stand-ins and desks."""
    if is_stand_in(name):
        return []
    t = unicodedata.normalize("NFKC", name).strip()
    if kind == "author":
        t = _BY.sub("", t)
    else:
        for _ in range(3):
            t = _COMPANY.sub("", _BRACKETS.sub("", t)) or t
        t = _THE.sub("", t)
        t = _CAMEL.sub(" ", t)
    if t.count(",") == 1:
        last, first = t.split(",")
        if first.strip() and last.strip():
            t = f"{first} {last}"
    parts = [plain(p) for p in _PART.findall(t)]
    if kind == "author":
        if {p.rstrip(".") for p in parts} & DESK_WORDS:
            return []
        if len(parts) > 2:  # initials in the middle tell nothing
            parts = [parts[0], *[p for p in parts[1:-1] if len(p.rstrip(".")) > 1], parts[-1]]
    return parts


def is_short(kind: str, parts: list[str]) -> bool:
    """Whether a spelling leaves out so much that several names may be meant."""
    if kind == "author":
        return len(parts) < 2 or any(p.endswith(".") or len(p) == 1 for p in parts)
    return len(parts) < 2 or parts[-1].endswith(".") or len(parts[-1]) == 1


def _slip(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 4 and one_slip(a, b))


def _given(a: str, b: str) -> bool:
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if x == y or _slip(x, y):
        return True
    if len(x) == 1 or a.endswith("."):
        return y.startswith(x)
    return (y, x) in _SHORT


def same_name(kind: str, a: list[str], b: list[str]) -> float:
    """How well two spellings agree part by part: 1 as they stand, less with a slip, 0 if they are of different names."""
    if not a or not b:
        return 0.0
    if kind == "author":
        best = 1.0 if [p.rstrip(".") for p in a] in ([p.rstrip(".") for p in b], [p.rstrip(".") for p in b[::-1]]) else 0.0
        for x in {tuple(a), tuple(a[::-1])}:
            for y in {tuple(b), tuple(b[::-1])}:
                if len(x) < 2 or len(y) < 2 or min(len(x[-1].rstrip(".")), len(y[-1].rstrip("."))) < 2 or not _slip(x[-1], y[-1]):
                    continue
                if not _given(x[0], y[0]):
                    continue
                if len(x) == len(y) and not all(_slip(p, q) for p, q in zip(x[1:-1], y[1:-1])):
                    continue
                best = max(best, 1.0 if x[-1] == y[-1] else 0.7)
        return best
    x, y = "".join(a).replace(".", ""), "".join(b).replace(".", "")
    if x == y:
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and b[-1].endswith(".")):
        a, b = b, a
    if a[-1].endswith(".") or len(a[-1]) == 1:  # a shortened last part
        head, tail = a[:-1], a[-1].rstrip(".")
        if len(b) > len(head) and head and b[len(head)].startswith(tail) and all(_slip(p, q) for p, q in zip(head, b)):
            return 1.0 if all(p == q for p, q in zip(head, b)) else 0.7
        return 0.0
    if len(a) < len(b) and a == b[: len(a)] and is_short("publisher", a + ["."]) and not b[-1].endswith("."):
        return 0.9 if len(b) - len(a) >= 1 else 0.0
    if len(a) < len(b) and all(_slip(p, q) for p, q in zip(a, b)) and len("".join(a)) < 0.8 * len("".join(b)):
        return 0.6
    return 0.7 if len(x) >= 8 and one_slip(x, y) else 0.0


def grams_of(kind: str, parts: list[str]) -> list[str]:
    """The trigrams of a spelling that its vector is made of."""
    bare = [p.rstrip(".") for p in parts]
    if kind == "publisher":
        marked = [("", "^" + "".join(bare) + "$")]
    elif len(bare) == 1:
        marked = [("", f"^{bare[0]}$")]
    else:
        first, last = _FORMAL.get(bare[0], bare[0]), _FORMAL.get(bare[-1], bare[-1])
        marked = [(last[0], f"^{first}$"), *[(last[0], f"^{p}$") for p in bare[1:-1]], (first[0], f"^{last}$")]
    return sorted({c + m[k : k + 3] for c, m in marked for k in range(len(m) - 2)})


def slip_keys(kind: str, parts: list[str]) -> list[str]:
    """What two spellings share if a key slipped at the first letter of one part: that part without its first letter or
    with its first two in order, and how the other part begins or ends."""
    if kind != "author" or len(parts) < 2:
        return []
    bare = [p.rstrip(".") for p in parts]
    ends = (_FORMAL.get(bare[0], bare[0]), _FORMAL.get(bare[-1], bare[-1]))
    out = set()
    for a, b in (ends, ends[::-1]):
        if len(a) >= 4:
            for v in (a, a[1:], "~" + "".join(sorted(a[:2])) + a[2:]):
                out |= {f"{v} {b[:2]}", f"{v} -{b[-2:]}"}
    return sorted(out)


def initial_keys(kind: str, parts: list[str]) -> tuple[list[str], list[str]]:
    """Either part of a name with the initial of the other: of spellings that shorten a part, and of full ones."""
    if kind != "author" or len(parts) < 2:
        return [], []
    a, b = parts[0].rstrip("."), parts[-1].rstrip(".")
    keys = sorted({f"{b} {a[0]}", f"{a} {b[0]}"})
    return (keys, []) if is_short(kind, parts) else ([], keys)


def _initials(parts: list[str]) -> str:
    return "".join(sorted(_FORMAL.get(p.rstrip("."), p)[0] for p in (parts[0], parts[-1])))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = [parts_of(k, n) for k, n in zip(pdf["kind"], pdf["name"])]
        out = pdf.assign(parts=parts, grams=[grams_of(k, p) if p else [] for k, p in zip(pdf["kind"], parts)])
        out["slips"] = [slip_keys(k, p) for k, p in zip(pdf["kind"], parts)]
        both = [initial_keys(k, p) for k, p in zip(pdf["kind"], parts)]
        out["shortened"], out["in_full"] = [x for x, _ in both], [y for _, y in both]
        out["initials"] = [_initials(p) if p else "" for p in parts]
        out["short"] = [is_short(k, p) for k, p in zip(pdf["kind"], parts)]
        yield out[[bool(p) for p in parts]][["id", "kind", "name", "n", "parts", "grams", "slips", "shortened", "in_full", "initials", "short"]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fit = [same_name(k, list(a), list(b)) for k, a, b in zip(pdf["kind"], pdf["parts_a"], pdf["parts_b"])]
        swap = pdf["a"] > pdf["b"]
        out = pd.DataFrame({"kind": pdf["kind"], "a": pdf["a"].where(~swap, pdf["b"]), "b": pdf["b"].where(~swap, pdf["a"]), "cosine": pdf["cosine"], "fit": fit})
        yield out[out["fit"] > 0]


def _bare_cosine(a: list[str], b: list[str]) -> float:
    """The cosine of two spellings' trigrams, no part marked by the other's initial."""
    x, y = ({f"^{_FORMAL.get(p.rstrip('.'), p.rstrip('.'))}$"[k : k + 3] for p in parts for k in range(len(_FORMAL.get(p.rstrip("."), p.rstrip("."))))} for parts in (a, b))
    return len(x & y) / (len(x) * len(y)) ** 0.5


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(cosine=[_bare_cosine(list(a), list(b)) for a, b in zip(pdf["parts_a"], pdf["parts_b"])])


def apart(df: DataFrame) -> DataFrame:
    """Joined by shuffle. Everything here grows with the names, and short names in compressed files look smaller to the
    planner than their hash tables are."""
    return df.hint("merge")


def similar_pairs(names: DataFrame, min_cosine: float = MIN_COSINE) -> tuple[DataFrame, DataFrame]:
    """(spellings, pairs): spellings(kind, name, n, parts, short) that name someone, and every pair a < b of them whose cosine
    reaches `min_cosine` and whose parts agree: (kind, a, b, cosine, fit).

    A slip at the first letter of one part changes every trigram of the other, and a rare given name outweighs a common
    surname against its initial; pairs that agree but for these are found by keys of their own, and their cosine, where
    it falls short, is that of trigrams without initials.
    """
    named = names.select(F.xxhash64("kind", "name").alias("id"), "kind", "name", "n")
    spelt = stage(named.mapInPandas(_grams, "id bigint, kind string, name string, n bigint, parts array<string>, grams array<string>, slips array<string>, shortened array<string>, in_full array<string>, initials string, short boolean"), "spellings")
    total = spelt.count()
    long = spelt.select("id", "kind", F.explode("grams").alias("gram"))
    df = long.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    weighted = apart(long).join(apart(df), ["kind", "gram"]).select("id", F.xxhash64("kind", "gram").alias("gram"), "df", F.log1p(F.lit(float(total)) / (F.col("df") + FLOOR)).alias("w"))
    vectors = weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "w"))).alias("v"))  # bounded by a name's length
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    unit = F.transform("v", lambda x: F.struct(x["gram"].alias("gram"), (x["w"] / F.col("norm")).alias("w")))
    vectors = stage(vectors.withColumn("norm", norm).select("id", unit.alias("v")), "name-vectors")
    # what follows the prefix cannot reach the threshold on its own
    rest = lambda k: F.aggregate(F.slice("v", k + 1, F.size("v")), F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    keys = F.filter(F.transform("v", lambda x, k: F.when(rest(k) >= min_cosine**2, x["gram"])), lambda g: g.isNotNull())
    index = vectors.select("id", F.explode(keys).alias("gram"))
    met = apart(index.alias("x")).join(apart(index.alias("y")), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")))
    met = met.select(F.col("x.id").alias("p"), F.col("y.id").alias("q")).distinct()
    side = lambda s: apart(vectors.select(F.col("id").alias(s), F.map_from_entries("v").alias(f"v_{s}")))
    both = apart(apart(met).join(side("p"), "p")).join(side("q"), "q")
    dot = F.aggregate(F.map_keys("v_p"), F.lit(0.0), lambda s, g: s + F.try_element_at("v_p", g) * F.coalesce(F.try_element_at("v_q", g), F.lit(0.0)))
    near = stage(both.select("p", "q", dot.alias("cosine")).where(F.col("cosine") >= min_cosine), "near-names")
    who = lambda i, c: apart(spelt.select(F.col("id").alias(i), F.col("name").alias(c), F.col("parts").alias(f"parts_{c}"), F.col("kind").alias(f"kind_{c}")))
    named_pairs = lambda pairs: apart(apart(pairs).join(who("p", "a"), "p")).join(who("q", "b"), "q")
    close = named_pairs(near).select(F.col("kind_a").alias("kind"), "a", "b", "cosine", "parts_a", "parts_b")
    slipped = spelt.select("id", "initials", F.explode("slips").alias("key"))
    slipped = apart(slipped.alias("x")).join(apart(slipped.alias("y")), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.initials") != F.col("y.initials")))
    full = spelt.select(F.col("id").alias("other"), F.explode("in_full").alias("key"))
    short = apart(spelt.select("id", F.explode("shortened").alias("key"))).join(apart(full), "key")
    keyed = slipped.select(F.col("x.id").alias("p"), F.col("y.id").alias("q")).unionByName(short.select(F.least("id", "other").alias("p"), F.greatest("id", "other").alias("q"))).distinct()
    keyed = named_pairs(apart(keyed).join(apart(near), ["p", "q"], "left_anti")).select(F.col("kind_a").alias("kind"), "a", "b", F.lit(0.0).alias("cosine"), "parts_a", "parts_b")
    close = close.unionByName(keyed.mapInPandas(_bare, keyed.schema))
    return spelt.select("kind", "name", "n", "parts", "short"), close.mapInPandas(_verify, "kind string, a string, b string, cosine double, fit double")


def components(edges: DataFrame) -> DataFrame:
    """(kind, name, component) of the names in edges(kind, a, b): the smallest name that can be reached.

    Labels take the smallest label around them and then that label's own label, so their reach doubles each round;
    every round is written to the shared folder.
    """
    two = edges.select("kind", F.col("a").alias("name"), F.col("b").alias("other")).unionByName(edges.select("kind", F.col("b").alias("name"), F.col("a").alias("other")))
    two = stage(two, "links")
    labels = stage(two.groupBy("kind", "name").agg(F.least("name", F.min("other")).alias("component")), "labels")
    while True:
        around = apart(two).join(apart(labels.select("kind", F.col("name").alias("other"), F.col("component").alias("c"))), ["kind", "other"]).groupBy("kind", "name").agg(F.min("c").alias("c"))
        step = apart(labels).join(apart(around), ["kind", "name"]).select("kind", "name", F.least("component", "c").alias("to"), F.col("component").alias("was"))
        step = stage(step, "labels")
        root = step.select("kind", F.col("name").alias("to"), F.col("to").alias("far"))
        moved = stage(apart(step).join(apart(root), ["kind", "to"], "left").select("kind", "name", F.least("to", "far").alias("component"), "was"), "labels")
        unstage(step, labels)
        labels = moved.select("kind", "name", "component")
        labels._staged_at = moved._staged_at
        if moved.where(F.col("component") != F.col("was")).isEmpty():
            unstage(two)
            return labels


def bounded_components(edges: DataFrame, most: int = MAX_COMPONENT) -> DataFrame:
    """(kind, name, component) as `components` has it, except that a component of over `most` names falls apart into those
    of its stronger links, step by step up to the strongest, so that no chain of slips fills one task.

    edges(kind, a, b, cosine, fit). Names that lose all their links this way are components of their own and are left out.
    What is dropped may be links that average linkage merges over, so no groups are made of this; see `linked_groups`.
    """
    labels, left = components(edges), edges
    done = None
    for least in STRONGER:
        sizes = labels.groupBy("kind", "component").agg(F.count("*").alias("n"))
        big = stage(apart(labels).join(apart(sizes.where(F.col("n") > most)), ["kind", "component"]).select("kind", "name", "component"), "large-components")
        if big.isEmpty():
            break
        fine = apart(labels).join(apart(big), ["kind", "name"], "left_anti").select("kind", "name", "component")
        done = fine if done is None else done.unionByName(fine)
        left = stage(apart(left.where(F.col("cosine") * F.col("fit") >= least)).join(apart(big.select("kind", F.col("name").alias("a"))), ["kind", "a"], "left_semi"), "stronger-links")
        labels = components(left)
    return labels if done is None else done.unionByName(labels)


def average_linkage(weights: dict[str, float], edges: dict[tuple[str, str], float], least: float) -> list[list[str]]:
    """Groups of names by average linkage over a sparse similarity (missing pairs are 0), names weighted.

    Pairs of groups are merged from the most similar down to `least`. Only existing links are kept, so the memory
    follows the links.
    """
    members = {k: [k] for k in weights}
    mass = dict(weights)
    sums: dict[str, dict[str, float]] = defaultdict(dict)
    for (a, b), s in edges.items():
        sums[a][b] = sums[b][a] = s * weights[a] * weights[b]
    heap = [(-s / (mass[a] * mass[b]), a, b) for a in sums for b, s in sums[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        if -d < least:
            break
        if a not in members or b not in members or b not in sums[a] or abs(-d - sums[a][b] / (mass[a] * mass[b])) > 1e-12:
            continue
        members[a] += members.pop(b)
        mass[a] += mass.pop(b)
        del sums[a][b], sums[b][a]
        for c, s in sums.pop(b).items():
            del sums[c][b]
            sums[a][c] = sums[c][a] = sums[a].get(c, 0.0) + s
        for c, s in sums[a].items():
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-s / (mass[a] * mass[c]), x, y))
    return list(members.values())


def linked_groups(nodes: DataFrame, links: DataFrame, least: float, most: int = MAX_COMPONENT) -> DataFrame:
    """(kind, name, entity) of nodes(kind, name, n) over links(kind, a, b, s), a < b: the groups of `average_linkage`, each
    under its smallest name, single names too, with no link left out.

    Groups never merge over an average below `least`, and an average is never above the larger one that it is made of. So
    components of the links that reach `least` are clustered apart, each with all links between its names, and two groups
    that are each other's first choice can be merged at once, in any order. In components of over `most` groups that is
    done in rounds over tables until they fit a task, or until rounds merge too few; then a task takes a component as it is.
    """
    spark = nodes.sparkSession
    members = nodes.select("kind", "name", F.col("name").alias("top"))
    mass = stage(nodes.select("kind", F.col("name").alias("top"), F.col("n").cast("double").alias("n")), "group-weights")
    side = lambda t, e: apart(t.select("kind", F.col("top").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in t.columns if c not in ("kind", "top")]))
    weigh = lambda df: apart(apart(df).join(side(mass, "a"), ["kind", "a"])).join(side(mass, "b"), ["kind", "b"])
    rated = stage(weigh(links).select("kind", "a", "b", "s", (F.col("s") * F.col("n_a") * F.col("n_b")).alias("total")), "rated-links")
    done = None
    while True:
        strong = rated.where(F.col("s") >= least)
        labels = components(strong)
        sizes = labels.groupBy("kind", "component").agg(F.count("*").alias("groups"))
        large = stage(apart(labels).join(apart(sizes.where(F.col("groups") > most)), ["kind", "component"]).select("kind", F.col("name").alias("top")), "large-components")
        ends = strong.select("kind", F.explode(F.array("a", "b")).alias("top"), F.struct((-F.col("s")).alias("far"), "a", "b").alias("link"))
        first = apart(ends).join(apart(large), ["kind", "top"], "left_semi").groupBy("kind", "top").agg(F.min("link").alias("link"))
        both = stage(first.groupBy("kind", F.col("link.a").alias("to"), F.col("link.b").alias("top")).agg(F.count("*").alias("n")).where(F.col("n") == 2).drop("n"), "merged-groups")
        rest = large if both.count() * WORTH >= large.count() else large.limit(0)
        fits = apart(mass).join(apart(rest), ["kind", "top"], "left_anti").join(apart(labels.select("kind", F.col("name").alias("top"), "component")), ["kind", "top"], "left")
        points = fits.select("kind", F.coalesce("component", "top").alias("component"), F.col("top").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n").alias("x"))
        inner = apart(rated).join(side(points.select("kind", F.col("a").alias("top"), "component"), "a"), ["kind", "a"]).join(side(points.select("kind", F.col("a").alias("top"), "component"), "b"), ["kind", "b"])
        inner = inner.where(F.col("component_a") == F.col("component_b")).select("kind", F.col("component_a").alias("component"), "a", "b", F.col("s").alias("x"))

        def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
            single = pdf["b"].isna()
            weights = dict(zip(pdf["a"][single], pdf["x"][single]))
            edges = {(a, b): x for a, b, x in zip(pdf["a"][~single], pdf["b"][~single], pdf["x"][~single])}
            groups = average_linkage({k: weights[k] for k in sorted(weights)}, edges, least)
            return pd.DataFrame([(pdf["kind"].iloc[0], a, min(g)) for g in groups for a in g], columns=["kind", "top", "entity"])

        solved = points.unionByName(inner).repartition(_tasks(spark), "kind", "component").groupBy("kind", "component").applyInPandas(cluster, "kind string, top string, entity string")
        named = stage(apart(members).join(apart(solved), ["kind", "top"]).select("kind", "name", "entity"), "linked-groups")
        done = named if done is None else done.unionByName(named)
        if rest.isEmpty():
            return done
        into = lambda df, e: apart(df).join(apart(both.select("kind", F.col("top").alias(e), F.col("to").alias(f"to_{e}"))), ["kind", e], "left").withColumn(e, F.coalesce(f"to_{e}", e)).drop(f"to_{e}")
        members = stage(into(apart(members).join(apart(rest), ["kind", "top"], "left_semi"), "top"), "group-members")
        mass = stage(into(apart(mass).join(apart(rest), ["kind", "top"], "left_semi"), "top").groupBy("kind", "top").agg(F.sum("n").alias("n")), "group-weights")
        moved = into(into(rated, "a"), "b").where(F.col("a") != F.col("b")).groupBy("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        rated = stage(weigh(moved).select("kind", "a", "b", (F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("s"), "total"), "rated-links")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def large_groups(spelt: DataFrame, pairs: DataFrame, most: int = MAX_COMPONENT) -> DataFrame:
    """What `_group` makes of a component, for components of any size, from tables: (kind, name, entity)."""
    links = pairs.select("kind", "a", "b", (F.col("cosine") * F.col("fit")).alias("s"))
    among = lambda some: apart(apart(links).join(apart(some.select("kind", F.col("name").alias("a"))), ["kind", "a"], "left_semi")).join(apart(some.select("kind", F.col("name").alias("b"))), ["kind", "b"], "left_semi")
    full, short = spelt.where(~F.col("short")), spelt.where(F.col("short"))
    groups = stage(linked_groups(full, among(full), MIN_LINK, most), "full-names")
    two = pairs.select("kind", F.col("a").alias("name"), F.col("b").alias("other"), "fit").unionByName(pairs.select("kind", F.col("b").alias("name"), F.col("a").alias("other"), "fit"))
    near = apart(apart(two).join(apart(short.select("kind", "name")), ["kind", "name"], "left_semi")).join(apart(groups.select("kind", F.col("name").alias("other"), "entity")), ["kind", "other"])
    near = near.groupBy("kind", "name", "fit").agg(F.min("entity").alias("entity"), F.max("entity").alias("last"))
    best = stage(near.groupBy("kind", "name").agg(F.max(F.struct("fit", "entity", "last")).alias("x")).select("kind", "name", "x.entity", "x.last"), "short-names")
    # short spellings that no full one fits stand together if they fit each other
    waiting = stage(apart(short).join(apart(best), ["kind", "name"], "left_anti").select("kind", "name", "n"), "waiting-names")
    lone = linked_groups(waiting, among(waiting), LONE_LINK, most)
    told = stage(groups.unionByName(best.where(F.col("entity") == F.col("last")).drop("last")).unionByName(lone), "large-groups")
    first = told.groupBy("kind", "entity").agg(F.min("name").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    return apart(told).join(apart(first), ["kind", "entity"]).select("kind", "name", F.col("first").alias("entity"))


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component: rows of names (b is NULL) and of links."""
    kind = pdf["kind"].iloc[0]
    names = pdf[pdf["b"].isna()].sort_values("a")
    parts = {a: list(p) for a, p in zip(names["a"], names["parts"])}
    weights = {a: float(n) for a, n in zip(names["a"], names["n"])}
    links = {(a, b): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["cosine"] * pdf["fit"]) if isinstance(b, str)}
    fits = {(a, b): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["fit"]) if isinstance(b, str)}
    short = {a for a in parts if is_short(kind, parts[a])}
    full = {a: w for a, w in weights.items() if a not in short}
    groups = average_linkage(full, {k: s for k, s in links.items() if k[0] in full and k[1] in full}, MIN_LINK)
    home = {a: g for g, group in enumerate(groups) for a in group}
    near: dict[str, list[tuple[float, int]]] = defaultdict(list)
    for (a, b), s in fits.items():
        for x, y in ((a, b), (b, a)):
            if x in short and y in home:
                near[x].append((s, home[y]))
    waiting: dict[str, float] = {}
    for a in sorted(short):
        best = max((s for s, _ in near[a]), default=0.0)
        fit = {g for s, g in near[a] if s == best}
        if len(fit) == 1:
            groups[fit.pop()].append(a)
        elif not fit:
            waiting[a] = weights[a]
    # short spellings that no full one fits stand together if they fit each other
    lone = average_linkage(waiting, {k: s for k, s in links.items() if k[0] in waiting and k[1] in waiting}, LONE_LINK)
    rows = [(kind, a, g[0]) for g in (sorted(g) for g in [*groups, *lone] if len(g) > 1) for a in g]
    return pd.DataFrame(rows, columns=["kind", "name", "entity"])


def name_groups(names: DataFrame, min_cosine: float = MIN_COSINE, most: int = MAX_COMPONENT) -> DataFrame:
    """names(kind, name, n): distinct spellings and how often each occurs -> (kind, name, entity).

    `entity` is the smallest spelling of the group. Spellings without a variant, stand-ins and desks give no row.
    kind is `author` or `publisher`; NULL names are ignored.
    """
    spelt, pairs = similar_pairs(names.where(F.col("name").isNotNull()), min_cosine)
    pairs = stage(pairs, "name-pairs")
    labels = components(pairs)
    sizes = labels.groupBy("kind", "component").agg(F.count("*").alias("n"))
    large = stage(apart(labels).join(apart(sizes.where(F.col("n") > most)), ["kind", "component"]).select("kind", "name"), "large-components")
    home, none_large = labels.select("kind", F.col("name").alias("a"), "component"), large.isEmpty()
    home = home if none_large else apart(home).join(apart(large.withColumnRenamed("name", "a")), ["kind", "a"], "left_anti")
    nodes = apart(spelt.withColumnRenamed("name", "a")).join(apart(home), ["kind", "a"]).select("kind", "component", "a", F.lit(None).cast("string").alias("b"), "n", "parts", F.lit(0.0).alias("cosine"), F.lit(0.0).alias("fit"))
    links = apart(pairs).join(apart(home), ["kind", "a"]).select("kind", "component", "a", "b", F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("parts"), "cosine", "fit")
    # dealt by number, which AQE leaves as it is: few bytes of names are much work
    small = nodes.unionByName(links).repartition(_tasks(names.sparkSession), "kind", "component").groupBy("kind", "component").applyInPandas(_group, "kind string, name string, entity string")
    if none_large:
        return small
    spelt = stage(apart(spelt).join(apart(large), ["kind", "name"], "left_semi"), "large-spellings")
    pairs = stage(apart(pairs).join(apart(large.withColumnRenamed("name", "a")), ["kind", "a"], "left_semi"), "large-pairs")
    return small.unionByName(large_groups(spelt, pairs, most))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(kind, name_a, name_b), name_a < name_b by code point: all pairs of spellings of one entity."""
    pair = groups.alias("x").join(groups.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.entity") == F.col("y.entity")) & (F.col("x.name") < F.col("y.name")))
    return pair.select(F.col("x.kind").alias("kind"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
