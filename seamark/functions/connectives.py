"""Causal connectives in English and Spanish, and the clauses around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Connectives by confidence tier.
ENGLISH = {
    "high": (
        "caused by",
        "was caused by",
        "were caused by",
        "resulted in",
        "resulting in",
        "led to",
        "leading to",
        "gave rise to",
        "brought about",
        "triggered",
        "precipitated",
        "induced",
        "produced",
        "generated",
        "provoked",
        "sparked",
        "engendered",
        "necessitated",
        "entailed",
    ),
    "medium": (
        "contributed to",
        "contributing to",
        "because of",
        "due to",
        "owing to",
        "on account of",
        "as a result of",
        "as a consequence of",
        "in response to",
        "stemmed from",
        "stems from",
        "arose from",
        "arises from",
        "originated from",
        "originates from",
        "attributable to",
        "attributed to",
        "linked to",
        "connected to",
        "associated with",
        "in the wake of",
        "in the aftermath of",
        "following",
        "after",
        "subsequently",
        "consequently",
        "therefore",
        "thus",
        "hence",
        "accordingly",
        "for this reason",
    ),
    "low": (
        "may have caused",
        "may have led to",
        "could have triggered",
        "might have resulted in",
        "possibly caused",
        "potentially led to",
        "appears to have caused",
        "seems to have caused",
        "is believed to have caused",
        "is thought to have triggered",
        "is suspected of causing",
        "coincided with",
        "correlated with",
        "occurred alongside",
        "preceded",
        "came before",
        "was followed by",
        "followed by",
    ),
}
SPANISH = {
    "high": (
        "causado por",
        "causada por",
        "causados por",
        "causadas por",
        "provocado por",
        "provocada por",
        "provocados por",
        "provocadas por",
        "generado por",
        "generada por",
        "resultado de",
        "resultante de",
        "condujo a",
        "llevó a",
        "desencadenó",
        "desencadenado por",
        "originó",
        "originado por",
        "produjo",
        "producido por",
        "dio lugar a",
        "dando lugar a",
        "trajo consigo",
        "derivó en",
        "derivado de",
        "suscitó",
    ),
    "medium": (
        "debido a",
        "a causa de",
        "a raíz de",
        "como resultado de",
        "como consecuencia de",
        "en respuesta a",
        "a consecuencia de",
        "por culpa de",
        "por motivo de",
        "por razón de",
        "en razón de",
        "contribuyó a",
        "contribuyendo a",
        "atribuido a",
        "atribuible a",
        "vinculado a",
        "vinculada a",
        "asociado con",
        "asociada con",
        "relacionado con",
        "relacionada con",
        "tras",
        "después de",
        "por lo tanto",
        "por consiguiente",
        "en consecuencia",
        "por ende",
        "de ahí que",
    ),
    "low": (
        "podría haber causado",
        "podría haber provocado",
        "posiblemente causó",
        "aparentemente causado por",
        "se cree que causó",
        "se sospecha que causó",
        "coincidió con",
        "correlacionado con",
        "precedió a",
        "seguido de",
        "seguido por",
    ),
}
TIERS = {"high": 0.85, "medium": 0.60, "low": 0.35}
# Connectives with the effect on their left, and words that negate.
BACKWARD = (
    "caused by",
    "was caused by",
    "were caused by",
    "due to",
    "owing to",
    "because of",
    "on account of",
    "as a result of",
    "as a consequence of",
    "stemmed from",
    "stems from",
    "arose from",
    "arises from",
    "originated from",
    "originates from",
    "attributable to",
    "attributed to",
    "in response to",
    "in the wake of",
    "in the aftermath of",
    "causado por",
    "causada por",
    "causados por",
    "causadas por",
    "provocado por",
    "provocada por",
    "provocados por",
    "provocadas por",
    "generado por",
    "generada por",
    "resultado de",
    "resultante de",
    "desencadenado por",
    "originado por",
    "producido por",
    "derivado de",
    "debido a",
    "a causa de",
    "a raíz de",
    "como resultado de",
    "como consecuencia de",
    "en respuesta a",
    "a consecuencia de",
    "por culpa de",
    "por motivo de",
    "por razón de",
    "en razón de",
    "atribuido a",
    "atribuible a",
)
NEGATIONS = (
    "not",
    "no",
    "never",
    "neither",
    "nor",
    "without",
    "hardly",
    "barely",
    "scarcely",
    "unlikely",
    "cannot",
    "nunca",
    "jamás",
    "tampoco",
    "ni",
    "sin",
    "apenas",
)


def _table() -> Column:
    backward = set(BACKWARD)
    rows = [F.struct(F.lit(p).alias("marker"), F.lit(t).alias("tier"), F.lit(TIERS[t]).alias("confidence"), F.lit(p in backward).alias("backward")) for lists in (ENGLISH, SPANISH) for t, ps in lists.items() for p in ps]
    return F.array(*rows)


def triplets(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cause, effect, marker, confidence and negation for every connective of every sentence.

    All connectives of a sentence count, overlapping ones too. Clauses of
    fewer than two words are dropped. A negation within four words before the
    marker is noted.
    """
    clean = F.trim(F.regexp_replace(F.lower("s"), r"[\s,;:()\"]+", " "))
    sentences = texts.select(F.col(id_col), F.explode(F.split(text_col, r"[.!?\n]+")).alias("s")).select(id_col, F.concat(F.lit(" "), clean, F.lit(" ")).alias("s"))
    hit = F.filter(_table(), lambda m: F.contains(F.col("s"), F.concat(F.lit(" "), m["marker"], F.lit(" "))))
    m = sentences.select(id_col, "s", F.explode(hit).alias("m")).select(id_col, "s", "m.*")
    spot = F.expr("locate(concat(' ', marker, ' '), s)")
    m = m.withColumn("left", F.trim(F.col("s").substr(F.lit(1), spot))).withColumn("right", F.trim(F.col("s").substr(spot + F.length("marker") + 1, F.length("s"))))
    words = F.split("left", " ")
    near = F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4))
    m = m.withColumn("negated", F.arrays_overlap(near, F.array(*[F.lit(w) for w in NEGATIONS])))
    m = m.withColumns({"cause": F.when(F.col("backward"), F.col("right")).otherwise(F.col("left")), "effect": F.when(F.col("backward"), F.col("left")).otherwise(F.col("right"))})
    long_enough = (F.size(F.split("cause", " ")) >= 2) & (F.size(F.split("effect", " ")) >= 2)
    return m.where(long_enough).select(id_col, "cause", "effect", "marker", "tier", "confidence", "negated")
