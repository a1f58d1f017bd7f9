"""Blank text: null, nothing visible, or a mere stand-in for "nothing"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, controls and the letters that show nothing.
_GAP = "[\\s\\p{Z}\\p{C}⠀ㅤᅟᅠ]*"
_WORDS = r"n\.?\s?/?\s?a\.?|none|null|nil|nan|empty|blank|undefined|missing|not available|(?:no|without|missing|empty) (?:response|answer|reply|content|text|message|data|output)|keine antwort|sin respuesta|pas de r[eé]ponse|ninguna?|aucune?|leer|vac[ií]o|vide|無|无|空|沒有|沒有回覆|没有回复|無回應"
#: For java.util.regex and for the regex module alike.
BLANK = rf"(?i)^{_GAP}(?:[-‐-―_.…·*~/\\]+|[\[(<{{\"']?{_GAP}(?:{_WORDS}){_GAP}[\])>}}\"']?\.?)?{_GAP}$"


def is_blank(col: Column) -> Column:
    """True for blank text, null included."""
    return F.coalesce(~col.isNotNull() | col.rlike(BLANK), F.lit(True))
