"""English stems (the Snowball "english" rules) as Column expressions over a table of distinct words."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The published rules. Suffixes of a step stand in any order; the longest one that a word ends in decides.
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = rf"^{OTHER}*{VOWEL}+{OTHER}"
LONG_STARTS = ("gener", "commun", "arsen")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SHORT_END = rf"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"
DOUBLE_END = r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
BEFORE = {"ogi": "l", "li": "[cdeghkmnrt]", "ion": "[st]"}  # what must stand before a suffix


def longest_first(suffixes) -> list[str]:
    return sorted(suffixes, key=lambda s: (-len(s), s))


def stems(words: DataFrame, column: str = "lexeme", out: str = "stem") -> DataFrame:
    """The distinct words of a column with their stems. Nulls are left out; words of two letters or less stay as they are."""
    w, n = F.col("w"), F.length("w")
    rows = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    rows = rows.withColumn("w", F.regexp_replace(F.regexp_replace("word", "^y", "Y"), f"({VOWEL})y", "$1Y"))
    first = F.length(F.regexp_extract("w", REGION, 0))
    start = F.when(first > 0, first).otherwise(n)
    for s in LONG_STARTS:
        start = F.when(F.col("word").startswith(s), len(s)).otherwise(start)
    rows = rows.withColumn("r1", start)
    second = F.length(F.regexp_extract(F.substr("w", F.col("r1") + 1), REGION, 0))
    rows = rows.withColumn("r2", F.when(second > 0, F.col("r1") + second).otherwise(n))

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substr(w, F.lit(1), n - k), F.lit(add)) if add else F.substr(w, F.lit(1), n - k)

    def within(region: str, suffix: str) -> Column:
        return n - len(suffix) >= F.col(region)

    def preceded(suffix: str) -> Column:
        return w.rlike(BEFORE[suffix] + suffix + "$") if suffix in BEFORE else F.lit(True)

    def step(rules: list[tuple[str, Column]]) -> DataFrame:
        out = None
        for suffix, new in rules:
            hit = w.endswith(suffix)
            out = F.when(hit, new) if out is None else out.when(hit, new)
        return rows.withColumn("w", out.otherwise(w))

    rows = step([
        ("sses", cut(2)), ("ied", F.when(n > 4, cut(2)).otherwise(cut(1))), ("ies", F.when(n > 4, cut(2)).otherwise(cut(1))),
        ("us", w), ("ss", w), ("s", F.when(w.rlike(f"{VOWEL}.+s$"), cut(1)).otherwise(w))])
    rows = rows.withColumn("done", w.isin(*KEPT_AFTER_PLURALS))
    # The part before an ending must hold a vowel.
    ended = F.regexp_extract("w", "^(.*)(edly|ingly|ed|ing)$", 2)
    kept = F.when(w.rlike("eed(ly)?$"), F.lit("")).otherwise(ended)
    rows = rows.withColumn("ending", kept).withColumn("ending", F.when(F.substr(w, F.lit(1), n - F.length("ending")).rlike(VOWEL), F.col("ending")).otherwise(""))
    rows = rows.withColumn("w", F.when(w.endswith("eedly"), F.when(within("r1", "eedly"), cut(3)).otherwise(w))
                           .when(w.endswith("eed"), F.when(within("r1", "eed"), cut(1)).otherwise(w)).otherwise(F.substr(w, F.lit(1), n - F.length("ending"))))
    rows = rows.withColumn("w", F.when(F.col("ending") == "", w).when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
                           .when(w.rlike(DOUBLE_END), cut(1)).when(w.rlike(SHORT_END) & (F.col("r1") >= n), F.concat(w, F.lit("e"))).otherwise(w))
    rows = rows.withColumn("w", F.when(w.rlike(f"^.+{OTHER}[yY]$"), cut(1, "i")).otherwise(w))
    rows = step([(s, F.when(within("r1", s) & preceded(s), cut(len(s), STEP_2[s])).otherwise(w)) for s in longest_first(STEP_2)])
    rows = step([(s, F.when(within("r2" if s == "ative" else "r1", s), cut(len(s), STEP_3[s])).otherwise(w)) for s in longest_first(STEP_3)])
    rows = step([(s, F.when(within("r2", s) & preceded(s), cut(len(s))).otherwise(w)) for s in longest_first(STEP_4)])
    last = F.when(within("r2", "e") | (within("r1", "e") & ~cut(1).rlike(SHORT_END)), cut(1)).otherwise(w)
    rows = step([("e", last), ("l", F.when(within("r2", "l") & w.endswith("ll"), cut(1)).otherwise(w))])
    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    after_plurals = F.regexp_replace("word", "s$", "")
    stem = F.when(F.length("word") <= 2, F.col("word")).when(F.col("done"), after_plurals).otherwise(F.replace(w, F.lit("Y"), F.lit("y")))
    return rows.select(F.col("word").alias(column), F.coalesce(F.try_element_at(whole, F.col("word")), stem).alias(out))
