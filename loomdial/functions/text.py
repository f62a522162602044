"""Text helpers as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "一-龥"

#: Full-width forms of printable ASCII and the ideographic space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

# Traditional characters and their simplified forms, pair by pair (those usual in teaching labels).
TRADITIONAL = "優識學習導問設語層點類憶應創價評誤錯檢測總結發遷勵開觀動時長師題說課講讀寫話對錯達難階無複饋確認記錄進論證據斷聯繫統義現實驗標準過這個們來為與後裡還會嗎讓從將當經變關係圖書館體號計備務啟維"
SIMPLIFIED = "优识学习导问设语层点类忆应创价评误错检测总结发迁励开观动时长师题说课讲读写话对错达难阶无复馈确认记录进论证据断联系统义现实验标准过这个们来为与后里还会吗让从将当经变关系图书馆体号计备务启维"

BLANK = r"[\s  ᠎ -‏    ⁠　﻿]"
#: The same characters one by one.
_BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def half_width(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def simplified(c: Column) -> Column:
    return F.translate(c, TRADITIONAL, SIMPLIFIED)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode blank, zero-width ones too; linear in the text, whatever blanks stand within it."""
    return F.btrim(c, F.lit(_BLANKS))


def id_key(c: Column) -> Column:
    """Ids that differ only in writing get one key: width, case, separators and leading zeros go. Null or blank: null.

    'Topic 7', 'topic-007' and ' TOPIC_７' all give 'topic7'.
    """
    bare = F.regexp_replace(F.lower(half_width(c)), r"[\s_\-\p{Cf}]+", "")
    return F.nullif(F.regexp_replace(bare, r"(?<![0-9])0+(?=[0-9])", ""), F.lit(""))


def text_key(c: Column) -> Column:
    """Keep Han characters, ASCII letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), f"[^{HAN}a-z0-9]", "")
