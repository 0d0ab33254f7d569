"""Postal addresses: their parts, and which of them denote one building.

``parse`` reads the parts of one written address (city, street kind and name, side street,
house number, postcode) from Persian or Latin script in any order. ``same_building`` links
addresses: see there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.sources.tables import keep, spread

_DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩يكةۀ", "01234567890123456789یکهه", "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u200e\u200f")

# Cities by their written forms.
CITIES = {
    "تهران": "tehran", "اصفهان": "isfahan", "مشهد": "mashhad", "شیراز": "shiraz", "تبریز": "tabriz", "کرج": "karaj", "رشت": "rasht", "کرمان": "kerman", "اهواز": "ahvaz",
    "قم": "qom", "همدان": "hamedan", "کرمانشاه": "kermanshah", "ارومیه": "urmia", "یزد": "yazd", "زاهدان": "zahedan",
    "esfahan": "isfahan", "hamadan": "hamedan", "ahwaz": "ahvaz", "orumiyeh": "urmia", "ghom": "qom",
}
_CITY = CITIES | {v: v for v in CITIES.values()}

_W = r"[^\W\d_]+"
_GAP = r"[\s.:]*"
_END = r"(?=$|[\s,،;؛/|\-–()#])"
#: A word that begins another part, so it can't belong to a name.
_KEY = r"(?:خیابان|خیابون|بلوار|بل|خ|ب|کوچه|کوی|ک|پلاک|پ|شماره|طبقه|ط|واحد|و|کدپستی|کد|استان|شهر|ایران|آدرس|نشانی|no|nr|pelak|plaque|floor|fl|apt|unit|suite|alley|aly|lane|ln|koocheh|kooche|street|str|st|boulevard|blvd|boul|bolvar|khiaban|postal|iran|p)"
_NAME = rf"(?!{_KEY}\b){_W}"
_TAIL = rf"(?:\s+{_NAME}){{0,2}}"

_POSTCODE = re.compile(r"(?:کد\s*پستی|ک\s*\.?\s*پ|postal\s*code|p\s*\.?\s*c|zip)?[\s.:]*(?<!\d)(\d{5}-?\d{5})(?!\d)", re.I)
_FLOOR_UNIT = re.compile(
    rf"(?<![^\W\d_])(?:طبقه|ط|floor|fl){_GAP}(?:\d+|اول|دوم|سوم|چهارم|پنجم|ششم|هفتم|هشتم|نهم|دهم|همکف|ground|{_W}(?=$|[,،;؛/|\n]))|(?<![^\W\d_])(?:واحد|و|apt|unit|suite|ste){_GAP}\d+", re.I
)
_NUMBER = re.compile(r"(?:(?<![^\W\d_])(?:پلاک|پ|شماره|pelak|plaque|no|nr)[\s.:]*|#\s*)(\d+)(?!\d)", re.I)
_FA_ALLEY = re.compile(rf"(?<![^\W\d_])(?:کوچه|کوی|بن\s?بست|ک)[\s.:]+(\d+|{_NAME}{_TAIL})")
_EN_ALLEY_NUMBER = re.compile(r"(?<![^\W\d_])(?:koocheh|kooche|kuche|alley|aly|lane|ln)[\s.]+(\d+)(?!\w)", re.I)
_EN_ALLEY = re.compile(rf"(?<![^\W\d_])(?:({_NAME})\s+(?:alley|aly|lane|ln)\b\.?|(?:koocheh|kooche|kuche)\s+({_NAME}))", re.I)
_FA_STREET = re.compile(rf"(?<![^\W\d_])(خیابان|خیابون|بلوار|بل|خ|ب)[\s.:]+({_NAME}{_TAIL})")
_EN_STREET = re.compile(rf"(?<![^\W\d_])(?:(khiaban|kh|bolvar|blvr)[\s.]+({_NAME}{_TAIL})|((?:{_NAME}\s+){{1,3}})(street|str|st|boulevard|blvd|boul|avenue|ave)\b\.?)", re.I)
_BARE = re.compile(r"(?<![\w#])(\d{1,5})(?!\w)")
_BOULEVARD = {"بلوار", "بل", "ب", "bolvar", "blvr", "boulevard", "blvd", "boul"}
_LABEL = re.compile(r"(?:آدرس|نشانی|دفتر مرکزی|address)\s*:", re.I)


#: Words that name no place, and the mark of a place that isn't in the list of cities.
_NO_PLACE = {"iran", "ایران", "استان", "شهر", "شهرستان", "province", "city", "آدرس", "نشانی", "address", "office", "دفتر", "مرکزی", "تلفن", "tel"}
UNREAD = "?"


class Address(NamedTuple):
    """Parts of an address; '' where a part isn't given."""

    city: str = ""
    kind: str = ""
    street: str = ""
    alley: str = ""
    number: str = ""
    postcode: str = ""


_NONE = Address()


def _take(pattern: re.Pattern, text: str) -> tuple[re.Match | None, str]:
    m = pattern.search(text)
    return (m, text[: m.start()] + " , " + text[m.end() :]) if m else (None, text)


def _without_city(words: str) -> tuple[str, str]:
    """Trailing city and country words aren't part of a name."""
    kept, city = words.split(), ""
    while len(kept) > 1 and (kept[-1] in _CITY or kept[-1] in ("ایران", "iran")):
        city = _CITY.get(kept.pop(), city)
    while len(kept) > 2 and kept[0] in _CITY:
        city = _CITY[kept.pop(0)]
    return " ".join(kept), city


def parse(text: str | None) -> Address:
    """The parts of one address. NULL, blanks and placeholders give empty parts throughout."""
    if not text or not text.strip():
        return _NONE
    t = re.sub(r"[‌­]", "", _LABEL.sub(" ", text.translate(_DIGITS))).lower()
    t = re.sub(r"[\n\r\t]+", " , ", t)
    m, t = _take(_POSTCODE, t)
    postcode = m[1].replace("-", "") if m else ""
    t = _FLOOR_UNIT.sub(" , ", t)
    m, t = _take(_NUMBER, t)
    number = m[1].lstrip("0") if m else ""
    city, alley, kind, street = "", "", "", ""
    m, t = _take(_FA_ALLEY, t)
    if m:
        alley, city = _without_city(m[1])
    else:
        m, rest = _take(_EN_ALLEY_NUMBER, t)
        if not m or not number:  # without another number, the one after "X Lane" is the house's
            named, other = _take(_EN_ALLEY, t)
            m, rest = (named, other) if named else (m, rest)
        t = rest
        alley = next((g for g in m.groups() if g), "") if m else ""
    m, t = _take(_FA_STREET, t)
    if m:
        kind, (street, c) = m[1], _without_city(m[2])
        city = c or city
    else:
        m, t = _take(_EN_STREET, t)
        if m:
            kind, (street, c) = (m[1] or m[4]).lower(), _without_city(m[2] or m[3])
            city = c or city
    if not number and street:
        m, t = _take(_BARE, t)
        number = m[1].lstrip("0") if m else ""
    rest = re.findall(_W, t)
    for word in rest:
        city = _CITY.get(word, city)
    if not city and street:
        unread = [w for w in rest if w not in _NO_PLACE and len(w) > 1]
        city = UNREAD + " ".join(unread) if unread else ""  # a place not in the list is still a place of its own
    kind = ("blvd" if kind in _BOULEVARD else "st") if street else ""
    return Address(city, kind, street, alley.lstrip("0") if alley.isdigit() else alley, number, postcode)


def names_street(text: str | None) -> bool:
    return bool(parse(text).street)


def parsed(df: DataFrame, id_col: str = "id", address_col: str = "address", city_col: str | None = "city") -> DataFrame:
    """(id, city, kind, street, alley, number, postcode) of each row; a city column fills in where the address names none."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(a if isinstance(a, str) else None) for a in pdf["a"]]
            out = pd.DataFrame(rows, columns=list(Address._fields))
            known = pdf["c"].map(lambda c: _CITY.get(c.translate(_DIGITS).strip().lower(), "") if isinstance(c, str) else "")
            out["city"] = out["city"].where((out["city"] != "") & ~(out["city"].str.startswith(UNREAD) & (known != "")), known)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    city = F.col(city_col).cast("string") if city_col else F.lit(None).cast("string")
    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(address_col).cast("string").alias("a"), city.alias("c")).filter("a is not null")
    return spread(narrow).mapInPandas(walk, "id bigint, city string, kind string, street string, alley string, number string, postcode string")


def _slips(word: Column) -> Column:
    """A word and all ways to leave out one of its letters."""
    return F.array_union(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def corrections(words: DataFrame) -> DataFrame:
    """(word, meant, n): likely intended words of misspelt ones, from (word, n) counts.

    Two words meet if they become equal by leaving out at most one letter of each (so one
    letter more, less, other, or out of place); the one written is a slip if the other is at
    least four times as common, or if it occurs but once or twice and no oftener than the other. No list of names is needed.
    """
    slips = words.select("word", "n", F.explode(_slips(F.col("word"))).alias("rest")).filter("length(rest) > 2")
    a, b = slips.select(F.col("word").alias("word"), F.col("n").alias("n_word"), "rest"), slips.select(F.col("word").alias("meant"), "n", "rest")
    near = a.join(b, "rest").filter("word <> meant and (n >= 4 * n_word or (n_word <= 2 and (n > n_word or (n = n_word and meant > word))))")
    moved = F.array_sort(F.split("word", "")) == F.array_sort(F.split("meant", ""))
    return near.select("word", "meant", "n").distinct().filter((F.levenshtein("word", "meant") <= 1) | moved)


#: How often a part of records that match disagrees: a city is never misspelt into another, a side street hardly ever once it is read, codes at times.
SLIPS = {"city": 1e-6, "alley": 1e-4, "postcode": 0.01}


def sound(text: Column) -> Column:
    """Consonants of a name, written alike in Persian and Latin script: what is heard of it whatever the vowels."""
    low = F.lower(text)
    for two, one in (("kh", "x"), ("gh", "q"), ("sh", "c"), ("ch", "j"), ("zh", "z")):
        low = F.replace(low, F.lit(two), F.lit(one))
    low = F.translate(low, "بپتطثسصجچخدذضظزژرشغقفکگلمن", "bpttsssjjxdzzzzzrcqqfkglmn")
    return F.regexp_replace(F.regexp_replace(low, r"[^b-df-gj-np-txz0-9 ]|h|w|v|y", ""), r"(.)\1+", "$1")


def linkage_weights(patterns: list[tuple[tuple[int, ...], int]], chance: list[list[float]], slips: list[float] | None = None, rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Match probability of each agreement pattern by expectation-maximization.

    ``patterns``: levels per component (0 disagree, 1 missing on either side, 2 agree) with
    counts; ``chance``: how often two unrelated records have each level of each component,
    known from the components' own distributions. Components are taken as independent given
    match or not, as Fellegi and Sunter do; a missing value is a level with its own weight.
    Estimated here are the levels' frequencies among matches and the share of matches; how often matches disagree is given (``slips``).
    At most 27 patterns, so this runs on the driver.
    """
    if not patterns:
        return {}
    x, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    k = x.shape[1]
    u = np.clip(np.array(chance, float), 1e-6, 1.0)
    slip = np.array(slips if slips is not None else k * [0.01])
    # to begin with, a part is left out of matches as often as of others
    begin = np.column_stack([slip, u[:, 1] * (1 - slip), (1 - u[:, 1]) * (1 - slip)])
    begin = np.maximum(begin, 1e-9)
    m, prior, weight = begin.copy(), 0.8, 20 + 0.2 * n.sum()
    for _ in range(rounds):
        pm = prior * np.prod([m[j, x[:, j]] for j in range(k)], axis=0)
        pu = (1 - prior) * np.prod([u[j, x[:, j]] for j in range(k)], axis=0)
        g = pm / (pm + pu)
        for j in range(k):
            told = [(g * n)[x[:, j] == level].sum() + weight * begin[j, level] for level in (1, 2)]
            m[j, 1:] = np.array(told) / sum(told) * (1 - slip[j])
        prior = ((g * n).sum() + 8) / (n.sum() + 10)
    return {tuple(int(v) for v in p): float(v) for (p, _), v in zip(patterns, g)}


def _chance(spots: DataFrame, component: str) -> list[float]:
    """How often two random spots disagree, lack a value, or agree in a component."""
    by = spots.groupBy(component).agg(F.count("*").cast("double").alias("n"))
    total, blank, squares = by.agg(F.sum("n"), F.sum(F.when(F.col(component) == "", F.col("n")).otherwise(0.0)), F.sum(F.when(F.col(component) != "", F.col("n") * F.col("n")).otherwise(0.0))).collect()[0]
    if not total:
        return [0.3, 0.4, 0.3]
    missing, agree = 1 - (1 - blank / total) ** 2, squares / total**2
    return [max(1 - missing - agree, 1e-6), missing, agree]


def _level(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.when((x == "") | (y == ""), 1).when(x == y, 2).otherwise(0)


def buildings(df: DataFrame, id_col: str = "id", address_col: str = "address", city_col: str | None = "city") -> DataFrame:
    """(id, building) of each row whose address names a street and a number.

    1. Rows are reduced to classes of equally read addresses (partial aggregates on the map
       side), so copies cost nothing further and a hot building can't fill a task.
    2. Street words are corrected against the corpus's own commoner words.
    3. Blocks are (street, number); within one only the distinct (city, side street) pairs
       meet. Each pair has a level per component: city, side street, postcode.
    4. Expectation-maximization turns the levels into match probabilities, missing values
       included. A class that lacks a part joins the one likeliest class that has it, if that is more likely than not; if two
       that contradict each other are as likely, it stays apart.
    5. A second block, (postcode, number, sound of the street), joins what spelling or script kept apart.
    """
    rows = keep(parsed(df, id_col, address_col, city_col).filter("street <> '' and number <> ''"), "addresses")
    classes = rows.groupBy("street", "number", "city", "alley").agg(F.count("*").alias("n"), F.max("postcode").alias("postcode"), F.min("id").alias("cls"))
    classes = keep(classes, "address-classes")
    # commonness of a word: at how many house numbers it is written, so one busy building counts once
    words = classes.select(F.explode(F.array_distinct(F.split("street", " "))).alias("word"), "number").distinct().groupBy("word").agg(F.count("*").alias("n"))
    meant = keep(corrections(words), "corrections")

    def corrected(at: DataFrame) -> DataFrame:
        """Each reading with one more word put right; ``done`` is the place of the word put right before."""
        spelt = at.select("cls", "number", "key", "done", F.posexplode(F.split("key", " ")).alias("pos", "word")).filter("pos <> done").join(meant, "word")
        put = F.transform(F.split("key", " "), lambda w, i: F.when(i == F.col("pos"), F.col("meant")).otherwise(w))
        return spelt.select("cls", "number", F.array_join(put, " ").alias("key"), F.col("pos").alias("done"), "n")

    written = classes.select("cls", "number", F.col("street").alias("key"), F.lit(-1).alias("done"), F.lit(0).cast("bigint").alias("n"))
    once = keep(corrected(written), "read-once")
    readings = keep(written.unionByName(once).unionByName(corrected(once)).select("cls", "number", "key", "n"), "readings")  # read twice
    # the reading that most addresses of that number share; among equals the commoner word
    backed = readings.groupBy("key", "number").agg(F.count_distinct("cls").alias("backing"))
    chosen = readings.join(backed, ["key", "number"]).groupBy("cls").agg(F.max_by("key", F.struct("backing", "n", "key")).alias("key"))
    keyed = classes.join(chosen, "cls")
    spots = keyed.groupBy("key", "number", "city", "alley").agg(F.min("cls").alias("spot"), F.sum("n").alias("n"), F.max("postcode").alias("postcode"))
    spots = keep(spots, "spots")
    members = keep(keyed.join(spots.select("key", "number", "city", "alley", "spot"), ["key", "number", "city", "alley"]).select("cls", "spot"), "members")

    b = spots.select(*[F.col(c).alias(f"{c}_b") for c in ("key", "number", "city", "alley", "spot", "postcode", "n")])
    # only what lacks a part can join another: pairs of two full spots contradict each other and are never made
    meet = spots.filter("city = '' or alley = ''").join(b, (F.col("key") == F.col("key_b")) & (F.col("number") == F.col("number_b")) & (F.col("spot") != F.col("spot_b")))
    levels = meet.select(
        "spot", "spot_b", "city", "alley", "city_b", "alley_b", "n_b",
        _level("city", "city_b").alias("l_city"), _level("alley", "alley_b").alias("l_alley"), _level("postcode", "postcode_b").alias("l_post"),
    )
    levels = keep(levels, "levels")
    counted = levels.groupBy("l_city", "l_alley", "l_post").count().collect()  # at most 27 rows
    alike = spots.filter("n > 1").select(F.when(F.col("city") == "", 1).otherwise(2), F.when(F.col("alley") == "", 1).otherwise(2), F.when(F.col("postcode") == "", 1).otherwise(2), F.col("n") - 1)
    counted += alike.toDF("l_city", "l_alley", "l_post", "n").groupBy("l_city", "l_alley", "l_post").agg(F.sum("n")).collect()  # rows of one spot agree: at most 8 rows
    total: dict[tuple[int, ...], int] = {}
    for r in counted:
        total[(r[0], r[1], r[2])] = total.get((r[0], r[1], r[2]), 0) + r[3]
    weights = linkage_weights(list(total.items()), [_chance(spots, c) for c in SLIPS], list(SLIPS.values()))
    probability = F.coalesce(*[F.when((F.col("l_city") == p[0]) & (F.col("l_alley") == p[1]) & (F.col("l_post") == p[2]), F.lit(w)) for p, w in weights.items()], F.lit(0.0))
    # candidates: spots that know more than this one and don't contradict it
    more = ((F.col("city_b") != "").cast("int") + (F.col("alley_b") != "").cast("int")) - ((F.col("city") != "").cast("int") + (F.col("alley") != "").cast("int"))
    fits = levels.withColumn("p", probability).withColumn("more", more).filter("more > 0 and p >= 0.5")
    best = Window.partitionBy("spot")
    fits = fits.withColumn("score", F.col("l_post") * 10 + F.col("l_city") + F.col("l_alley")).withColumn("top", F.max(F.when(F.col("l_post") == 2, 1).otherwise(0)).over(best)).filter("top = 0 or l_post = 2")
    joint = fits.groupBy("spot").agg(
        F.count_distinct(F.when(F.col("city_b") != "", F.col("city_b"))).alias("cities"),
        F.count_distinct(F.when(F.col("alley_b") != "", F.col("alley_b"))).alias("alleys"),
        F.max_by("spot_b", F.struct("more", "n_b", "spot_b")).alias("into"),
    )
    links = joint.filter("cities <= 1 and alleys <= 1").select("spot", "into")
    # at most two steps: no city and no side street -> one of them -> both
    one = spots.select("spot").join(links, "spot", "left").select("spot", F.coalesce("into", "spot").alias("mid"))
    two = one.join(links.select(F.col("spot").alias("mid"), F.col("into").alias("far")), "mid", "left").select("spot", F.coalesce("far", "mid").alias("building"))
    final = two.select("spot", "building")
    # a second block: one postcode and number, and a street that sounds alike, whatever its script or spelling; so halves that
    # each lack what the other has meet as well. Cities and side streets must not contradict
    coded = keep(spots.filter("postcode <> ''").select("spot", "postcode", "number", sound(F.col("key")).alias("sounds"), F.nullif("city", F.lit("")).alias("city"), F.nullif(sound(F.col("alley")), F.lit("")).alias("alley")), "coded-spots")
    for _ in range(2):  # a building with two postcodes may join two others
        at = coded.join(final, "spot")
        agreed = at.groupBy("postcode", "number", "sounds").agg(F.min("building").alias("joint"), F.count_distinct("building").alias("n"), F.count_distinct("city").alias("cities"), F.count_distinct("alley").alias("alleys"))
        agreed = keep(agreed.filter("n > 1 and cities <= 1 and alleys <= 1"), "agreed")
        if agreed.isEmpty():
            break
        moved = at.join(agreed, ["postcode", "number", "sounds"]).groupBy("building").agg(F.min("joint").alias("joint"))
        final = keep(final.join(moved, "building", "left").select("spot", F.coalesce("joint", "building").alias("building")), "joined")
    by_class = keep(members.join(final, "spot").select("cls", "building"), "buildings")
    keys = classes.select("street", "number", "city", "alley", "cls").join(by_class, "cls").drop("cls")
    return rows.join(keys, ["street", "number", "city", "alley"]).select("id", "building")


def same_building(df: DataFrame, id_col: str = "id", address_col: str = "address", city_col: str | None = "city") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of rows at one building.

    NULL, blank and placeholder addresses and those that name no street or number have no
    pair; repeated rows of one id none with themselves.
    """
    at = buildings(df, id_col, address_col, city_col).distinct()
    a, b = at.withColumnRenamed("id", "id_a"), at.withColumnRenamed("id", "id_b")
    return a.join(b, "building").filter("id_a < id_b").select("id_a", "id_b")
