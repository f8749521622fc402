"""Text operators: traits with evidence, numbers in prose, claims against facts, clause segmentation."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that show each trait
TRAITS = {
    "coastal": r"\bbeach(?:es|side|front)?\b|\bcoast(?:al|line)?\b|(?<!north )(?<!the north )\bshores?\b|\bharbou?r\b|\bwaterfront\b|\bseaside\b|\bestuary\b|\bgulf\b|\bpeninsulas?\b|\binlet\b|\bfronts the\b|\btidal\b",
    "bush": r"\bforest(?:ed)?\b|\bbush(?:land|-clad)?\b|\brainforest\b|\bscenic reserve\b",
    "rural": r"\brural\b|\bfarmland\b|\bfarming\b|\bcountryside\b|\bsmall town\b|\bvillage(?! centre)\b|\btownship\b|\borchards?\b|\blifestyle blocks?\b",
    "volcanic": r"\bvolcan(?:o|oes|ic)\b|\bmaunga\b|\bcrater\b|\bscoria\b|\bcinder cone\b|\blava\b|\btuff ring\b",
    "town_centre": r"\b(?:town|shopping|commercial|retail|civic) (?:centre|center)\b|\bshopping (?:mall|precinct)\b|\bmain street\b|\bbusiness (?:district|area)\b|\bcommercial (?:hub|precinct)\b",
    "historic": r"\bhistoric(?:al)?\b|\bheritage\b|\boldest\b|\bVictorian\b|\bcolonial\b|\b(?:established|settled|founded) in 1[89]\d\d\b",
    "industrial": r"\bindustrial\b|\bindustry\b|\bmanufacturing\b|\bwarehous(?:e|ing|es)\b|\bfactor(?:y|ies)\b|\bport\b|\bquarry\b",
}
# What, earlier in the same sentence, makes a mention one of the past, or of something nearby
PAST_WORDS = "originally|formerly|once|previously|used to|no longer|until the|historically|in the past|was|were|had been|established as|founded|settled|developed into|during the|in the (?:17|18|19)\\d\\d"
NEAR_WORDS = "north of|south of|east of|west of|northeast of|northwest of|southeast of|southwest of|near|close to|view of|views of|overlooking|opposite|across from|adjacent to|lies|beyond|toward|towards|facing"
#: Traits that a place has by lying near what shows them.
BY_NEARNESS = {"coastal", "volcanic", "town_centre"}
# Phonetic signs, and names that contain a trait's word
GLOSS = r"\([^)]*[əˈˌːɑɛɪɔʊθðʃʒŋæ\u0361][^)]*\)"
OTHER_NAMES = r"\bharbou?r bridge\b|\bnorth shore (?:city|hospital)\b"
#: Stands where the place's own name stood.
SLOT = "\u2e24\u2e25"


_RULES = {
    "past": re.compile(rf"\b(?:{PAST_WORDS})\b[^.;]{{0,60}}$", re.I),
    "near": re.compile(rf"\b(?:{NEAR_WORDS})\b[^.;]{{0,50}}$", re.I),
    "compound": re.compile(rf"{SLOT}\W{{0,3}}$"),
}
_BLANKED = re.compile(rf"{GLOSS}|{OTHER_NAMES}", re.I)
_SENTENCE = re.compile(r"[^.;]+")


def shown_traits(text: str, name: str | None, patterns: dict[str, re.Pattern], around: int = 34) -> dict[str, str]:
    """The traits of one text with their evidence, sentence by sentence."""
    body = _BLANKED.sub(" ", text)
    if name and name.strip():
        body = re.sub(re.escape(name), SLOT, body, flags=re.I)
    spans = [m.span() for m in _SENTENCE.finditer(body)]
    found = {}
    for trait, pattern in patterns.items():
        rules = ["past"] if trait in BY_NEARNESS else list(_RULES)
        hits = ((a, m) for a, z in spans for m in pattern.finditer(body, a, z))
        # what rules a mention out stands at most 120 characters before it
        valid = (m for a, m in hits if not any(_RULES[r].search(body[max(a, m.start() - 120) : m.start()]) for r in rules))
        if m := next(valid, None):
            a, z = max(0, m.start() - around), min(len(body), m.end() + around)
            found[trait] = "".join(["…" * (a > 0), " ".join(body[a:z].split()), "…" * (z < len(body))])
    return found


def traits(df: DataFrame, key: str, text: str, name: str | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, traits): map of trait to evidence for each row; null texts have an empty map.

    A trait is shown by its first mention that is not ruled out: by a word of the past within 60 characters before it in its sentence, and, for
    traits that lying nearby does not give, by a word of nearness within 50 or by the place's own name directly in front. Glosses of
    pronunciation, other names that contain such words and the place's own name (column `name`) show nothing.
    """
    kind = dict(df.dtypes)[key]
    chosen = {k: re.compile(p, re.I) for k, p in (patterns or TRAITS).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [shown_traits(t, n if isinstance(n, str) else None, chosen) if isinstance(t, str) else {} for t, n in zip(pdf["text"], pdf["name"])]
            yield pd.DataFrame({"key": pdf["key"].array, "traits": made})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))
    return rows.mapInPandas(run, f"key {kind}, traits map<string,string>").withColumnRenamed("key", key)


def coverage(with_traits: DataFrame) -> DataFrame:
    """(trait, texts): how many texts show each trait, 'none' for those that show none."""
    names = F.when(F.size("traits") > 0, F.map_keys("traits")).otherwise(F.array(F.lit("none")))
    return with_traits.select(F.explode(names).alias("trait")).groupBy("trait").agg(F.count("*").alias("texts"))


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
#: What numbers in prose stand for: the pattern (number, unit) and what a unit multiplies by.
FIGURES = {
    "money": (rf"\$({NUMBER})([mkMK]?)", {"m": 1e6, "k": 1e3}),
    "money_zh": (rf"({NUMBER})\s*(百万|万)元?", {"百万": 1e6, "万": 1e4}),
    "percent": (rf"({NUMBER})\s*(%|per cent)", {}),
    "km": (rf"({NUMBER})\s*(km)\b", {}),
}


def figures(text: Column, kind: str) -> Column:
    """The numbers of one kind in a text as doubles, units multiplied out: $703,000, $1.2M, 98.5万, 4.2 %, 12 km."""
    pattern, units = FIGURES[kind]
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("u"))
    times = lambda u: F.coalesce(*[F.when(F.lower(u) == k, v) for k, v in units.items()], F.lit(1.0))
    return F.transform(parts, lambda x: F.regexp_replace(x["n"], ",", "").try_cast("double") * times(x["u"]))


def money(text: Column) -> Column:
    """The dollar amounts of a text: $703,000, $1.2m, $450K."""
    return figures(text, "money")


def supported(claims: DataFrame, facts: DataFrame, by: str, least: float, share: float, small: float = 0.15) -> DataFrame:
    """claims (by, claim) with supported: whether a fact (by, fact) of the same key lies close.

    Close is max(least, share of the fact), with the claim's sign, for facts of 1,000 and more; `small` for others.
    """
    near = F.when(F.abs("fact") >= 1_000, F.greatest(F.lit(least), F.abs("fact") * share)).otherwise(F.lit(small))
    close = F.abs(F.col("claim") - F.col("fact")) <= near
    c = claims.withColumn("_id", F.monotonically_increasing_id())
    return c.join(facts.select(by, "fact"), by, "left").groupBy("_id", *claims.columns).agg(F.coalesce(F.bool_or(close), F.lit(False)).alias("supported")).drop("_id")


def longest_run(numbers: list[tuple]) -> list[int]:
    """The places of a longest strictly increasing run; of several the one that ends in the smallest values."""
    tails, at, back = [], [], [-1] * len(numbers)
    for i, x in enumerate(numbers):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


CLAUSE = re.compile(r"^([A-Z]?\d+(?:\.\d+)*)\.?\s+(\S.*)$")
MARGIN = 88.0
SPLIT = re.compile(r"(?=\((?:\d+|[a-z]|[ivx]+)\) )")
OUT = "chapter string, clause string, part int, title string, page_from int, page_to int, status string, text string"


def _clauses(pdf: pd.DataFrame, most: int) -> list[tuple]:
    """The clauses of one chapter's positioned text runs."""
    rows = pdf.sort_values(["page", "y", "x"], ascending=[True, False, True])
    body = rows[rows["x"] >= MARGIN]
    notes = rows[rows["x"] < MARGIN]
    heads = [(i, m[1], m[2], p, x) for i, (t, p, x) in enumerate(zip(body["text"], body["page"], body["x"])) if (m := CLAUSE.match(str(t)))]
    if heads:
        # headings stand in one column; those in others are references or table rows
        column = pd.Series([round(h[4]) for h in heads]).mode()[0]
        heads = [h for h in heads if round(h[4]) == column]
        numbers = [tuple(int(x) for x in re.findall(r"\d+", h[1])) for h in heads]
        heads = [heads[k] for k in longest_run(numbers)]
    texts, pages, out = body["text"].astype(str).tolist(), body["page"].tolist(), []
    ends = [h[0] for h in heads[1:]] + [len(texts)]
    names = [h[1] for h in heads]
    for h, end in zip(heads, ends):
        text = " ".join(texts[h[0] + 1 : end]).strip()
        leaf = not any(n.startswith(h[1] + ".") for n in names)
        on = notes[(notes["page"] >= h[3]) & (notes["page"] <= pages[end - 1])]
        status = "active" if not leaf or len(text) >= 40 else "replaced" if len(on) else "empty"
        parts, piece = [], ""
        for bit in SPLIT.split(text):
            if piece and len(piece) + len(bit) > most:
                parts.append(piece)
                piece = ""
            piece += bit
        parts.append(piece)
        out += [(h[1], k + 1, h[2], h[3], pages[end - 1], status, p.strip()) for k, p in enumerate(parts)]
    return out


def segment(runs: DataFrame, most: int = 2_400) -> DataFrame:
    """Clauses of chapters given as positioned runs (chapter, page, x, y, text), y upwards.

    Headings are numbered runs in the column where most stand, in rising order; the text up to the next belongs to them; runs left of
    the margin are notes. A leaf of fewer than 40 characters is `replaced` if notes stand beside it, else `empty`. Long texts are
    split before (1), (a), (i). A chapter is one group: it is one document.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in _clauses(pdf.dropna(subset=["text"]), most)], columns=["chapter", "clause", "part", "title", "page_from", "page_to", "status", "text"])

    return runs.groupBy("chapter").applyInPandas(run, OUT)
