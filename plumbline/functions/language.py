"""The language of a text by its most common words, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, tokens

#: Words that are frequent in one of these languages, ordered by language.
COMMON: dict[str, tuple[str, ...]] = {
    code: tuple(words.split())
    for code, words in {
        "de": "aber als auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nach nicht noch oder sich sie sind und von war werden wie wird zu zum zur über",
        "en": "and are as at be been but by for from had has have he her his in is it its not of on or she that the their there they this to was were which who will with would you",
        "es": "al como con cuando de del el ella en era es esta este está fue ha hay la las lo los más muy no para pero por porque que se sin sobre son su sus también un una y ya",
        "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous été",
        "it": "al alla anche che come con da dei del della delle di e ed era gli ha i il in la le lo loro ma nel nella non per più quando questo se si sono su sua un una è",
        "nl": "aan als bij daar dan dat de deze die door een en er haar het hij hun ik in is je maar met naar niet nog om onder ook op te uit van voor was wat werd ze zich zijn zo",
        "pt": "ao aos as com como da das de do dos e ela ele em era essa este foi há isso já mais mas na nas no nos não o os ou para pela pelo por que se sem seu sua também um uma",
    }.items()
}


def _common(words: Column, terms: tuple[str, ...] | list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*terms)))


def detect(text: Column) -> Column:
    """struct<code, confidence>: the language with the most common words, the first by code in a tie, and its share of the words that are common in any.

    English with confidence 0.5 where there is no such word.
    """
    none = F.struct(F.lit("en").alias("code"), F.lit(0.5).alias("confidence"))

    def of(words: Column) -> Column:
        top = F.array_min(F.array(*(F.struct((-_common(words, terms)).alias("order"), F.lit(code).alias("code")) for code, terms in COMMON.items())))
        every = _common(words, sorted({w for terms in COMMON.values() for w in terms}))
        best = F.struct(top["code"].alias("code"), (-top["order"] / F.nullif(every, F.lit(0))).alias("confidence"))
        return F.when(every > 0, best).otherwise(none)

    return let(tokens(text), of)
