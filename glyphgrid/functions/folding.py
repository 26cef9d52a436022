"""ASCII folding as data: which characters fold, and to what."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_DOMAIN = """
AB B2-B3 B9 BB C0-D6 D8-F6 F8-183 186-18C 18E-193 195-19A 19C-1A1 1A4-1A5 1AB-1B0 1B2-1B6 1BF 1C4-1ED 1F0-240
243-250 253-262 265-266 268 26A-26D 26F-276 27C-282 284 287-289 28B-291 297 299-2A0 2A3 2A5-2A6 2A8 2AA-2AB
2AE-2AF 1D00-1D10 1D14-1D1C 1D20-1D22 1D62-1D65 1D6B-1D77 1D79-1D7E 1D80-1D8A 1D8C-1D8F 1D91-1D97 1D99
1E00-1E9E 1EA0-1EFC 1EFE-1EFF 2010-2014 2018-201E 2032-2033 2035-2036 2038-203A 203C 2044-2049 204E-204F
2052-2053 2070-2071 2074-208E 2090-2094 2184 2460-24FF 275B-275E 2768-2793 2C60-2C6C 2C6E-2C6F 2C71-2C76 2C78
2C7A-2C7C 2E28-2E29 A728-A729 A730-A75B A75E-A763 A766-A768 A779-A786 A7FB-A7FF FB00-FB04 FB06 FF01-FF3F
FF41-FF5B FF5D-FF5E
"""

#: What isn't its compatibility decomposition without marks: output, characters.
_OTHER = [
    ('"', '«»“”„″‶❝❞❮❯'),
    ('AE', 'ÆǢǼᴁ'),
    ('D', 'ÐĐƉƊƋᴅᴆꝹ'),
    ('O', 'ØƆƟǾᴏᴐꝊꝌ'),
    ('TH', 'ÞꝦ'),
    ('ss', 'ß'),
    ('ae', 'æǣǽᴂ'),
    ('d', 'ðđƌȡɖɗᵭᶁᶑꝺ'),
    ('o', 'øǿɔɵᴖᴗᶗⱺꝋꝍ'),
    ('th', 'þᵺꝧ'),
    ('H', 'ĦʜⱧⱵ'),
    ('h', 'ħɥɦʮʯⱨⱶ'),
    ('i', 'ıɨᴉᵼᶖ'),
    ('q', 'ĸɋʠꝗꝙ'),
    ('L', 'ĿŁȽʟᴌⱠⱢꝆꝈꞀ'),
    ('l', 'ŀłƚȴɫɬɭᶅⱡꝇꝉꞁ'),
    ('n', 'ŉŋƞȵɲɳᵰᶇ'),
    ('N', 'ŊƝȠɴᴎ'),
    ('OE', 'Œɶ'),
    ('oe', 'œᴔ'),
    ('T', 'ŦƬƮȾᴛꞆ'),
    ('t', 'ŧƫƭȶʇʈᵵⱦ'),
    ('b', 'ƀƃɓᵬᶀ'),
    ('B', 'ƁƂɃʙᴃ'),
    ('C', 'ƇȻʗᴄ'),
    ('c', 'ƈȼɕↄꜾꜿ'),
    ('E', 'ƎƐɆᴇⱻ'),
    ('A', 'ƏȺᴀ'),
    ('F', 'ƑꜰꝻꟻ'),
    ('f', 'ƒᵮᶂẛꝼ'),
    ('G', 'ƓǤǥǧɢʛꝽꝾ'),
    ('hv', 'ƕ'),
    ('I', 'ƖƗɪᵻꟾ'),
    ('K', 'ƘᴋⱩꝀꝂꝄ'),
    ('k', 'ƙʞᶄⱪꝁꝃꝅ'),
    ('M', 'ƜᴍⱮꟽꟿ'),
    ('P', 'ƤᴘⱣꝐꝒꝔ'),
    ('p', 'ƥᵱᵽᶈꝑꝓꝕꟼ'),
    ('V', 'ƲɅᴠỼꝞꝨ'),
    ('Y', 'ƳɎʏỾ'),
    ('y', 'ƴɏʎỿ'),
    ('Z', 'ƵȜȤᴢⱫꝢ'),
    ('z', 'ƶȝȥɀʐʑᵶᶎⱬꝣ'),
    ('w', 'ƿʍⱳ'),
    ('e', 'ǝɇɘɛɜɝɞʚᴈᶒᶓᶔⱸ'),
    ('HV', 'Ƕ'),
    ('W', 'ǷᴡⱲ'),
    ('OU', 'Ȣᴕ'),
    ('ou', 'ȣ'),
    ('j', 'ȷɉɟʄʝ'),
    ('db', 'ȸ'),
    ('qp', 'ȹ'),
    ('s', 'ȿʂᵴᶊẜẝꞄ'),
    ('U', 'Ʉᴜᵾ'),
    ('J', 'Ɉᴊ'),
    ('Q', 'ɊꝖꝘ'),
    ('R', 'ɌʀʁᴙᴚⱤꝚꞂ'),
    ('r', 'ɍɼɽɾɿᵲᵳᶉꝛꞃ'),
    ('a', 'ɐəɚᶏᶕẚₔⱥⱯ'),
    ('g', 'ɠɡᵷᵹᶃꝿ'),
    ('m', 'ɯɰɱᵯᶆ'),
    ('u', 'ʉᶙ'),
    ('v', 'ʋʌᶌⱱⱴꝟ'),
    ('dz', 'ʣʥ'),
    ('ts', 'ʦ'),
    ('tc', 'ʨ'),
    ('ls', 'ʪ'),
    ('lz', 'ʫ'),
    ('ue', 'ᵫ'),
    ('x', 'ᶍ'),
    ('SS', 'ẞ'),
    ('LL', 'Ỻ'),
    ('ll', 'ỻ'),
    ('-', '‐‑‒–—⁻₋'),
    ("'", '‘’‚‛′‵‹›❛❜'),
    ('^', '‸'),
    ('[', '⁅❲'),
    (']', '⁆❳'),
    ('*', '⁎'),
    (';', '⁏'),
    ('%', '⁒'),
    ('~', '⁓'),
    ('11', '⓫'),
    ('12', '⓬'),
    ('13', '⓭'),
    ('14', '⓮'),
    ('15', '⓯'),
    ('16', '⓰'),
    ('17', '⓱'),
    ('18', '⓲'),
    ('19', '⓳'),
    ('20', '⓴'),
    ('1', '⓵❶➀➊'),
    ('2', '⓶❷➁➋'),
    ('3', '⓷❸➂➌'),
    ('4', '⓸❹➃➍'),
    ('5', '⓹❺➄➎'),
    ('6', '⓺❻➅➏'),
    ('7', '⓻❼➆➐'),
    ('8', '⓼❽➇➑'),
    ('9', '⓽❾➈➒'),
    ('10', '⓾❿➉➓'),
    ('0', '⓿'),
    ('(', '❨❪'),
    (')', '❩❫'),
    ('<', '❬❰'),
    ('>', '❭❱'),
    ('{', '❴'),
    ('}', '❵'),
    ('((', '⸨'),
    ('))', '⸩'),
    ('TZ', 'Ꜩ'),
    ('tz', 'ꜩ'),
    ('S', 'ꜱꞅ'),
    ('AA', 'Ꜳ'),
    ('aa', 'ꜳ'),
    ('AO', 'Ꜵ'),
    ('ao', 'ꜵ'),
    ('AU', 'Ꜷ'),
    ('au', 'ꜷ'),
    ('AV', 'ꜸꜺ'),
    ('av', 'ꜹꜻ'),
    ('AY', 'Ꜽ'),
    ('ay', 'ꜽ'),
    ('OO', 'Ꝏ'),
    ('oo', 'ꝏ'),
    ('VY', 'Ꝡ'),
    ('vy', 'ꝡ'),
]


def _table() -> dict[str, str]:
    other = {c: out for out, chars in _OTHER for c in chars}
    table = {}
    for span in _DOMAIN.split():
        first, _, last = span.partition("-")
        for code in range(int(first, 16), int(last or first, 16) + 1):
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            table[c] = other.get(c, plain.replace("\u2044", "/"))
    return table


TABLE = _table()
_FOLDED = re.compile("[" + "".join(re.escape(c) for c in TABLE) + "]")


def fold_text(text: str) -> str:
    """The text with what the table has replaced; in ASCII as it is."""
    return text if text.isascii() else _FOLDED.sub(lambda m: TABLE[m[0]], text)


def fold(text: Column) -> Column:
    """fold_text() of a string column, in Arrow batches."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold_text(x) for x in values.to_pylist()], pa.string())

    return run(text)
