"""Font names of extracted text: normalised, matched to families that an editor has, with weight, slant and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, pick, values_and
from paperloom.operators.textops import direction
from paperloom.sources.tables import read

# Faces that a family has by name, and name parts that point to a family, the first that fits.
FACES = {f"{family.lower()}-{weight}": family for family in ("NotoSans", "NotoSansArabic", "Vazirmatn", "NotoSansHebrew") for weight in ("regular", "bold")}
PARTS = (("vazir", "Vazirmatn"), ("notosansarabic", "NotoSansArabic"), ("notonaskh", "NotoSansArabic"), ("courier", "monospace"), ("mono", "monospace"), ("consol", "monospace"), ("liberation.*sans|sans.*liberation", ""), ("times", "serif"), ("georgia", "serif"), ("liberation", "serif"), ("nimbusrom", "serif"))
HEBREW = "[\\u0590-\\u05FF]"


def font_name(raw: Column) -> Column:
    """Without a leading slash and the six capitals of a subset; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^/", ""), r"^[A-Z]{6}\+", "")


def font_style(raw: Column, text: Column, loaded: list[str] = []) -> Column:  # noqa: B006
    """Struct (family, kind, bold, italic): kind is exact for a loaded family's own face, named for a substitute, else unknown.

    Names decide first; text of a right-to-left script gets its script's family. "Liberation Sans" has no substitute.
    """
    name = F.lower(font_name(raw))
    face = F.create_map(*[F.lit(x) for pair in FACES.items() for x in pair])[name]
    part = F.lit(None).cast("string")
    for pattern, family in reversed(PARTS):
        part = F.when(name.rlike(pattern), family).otherwise(part)
    rtl = direction(text)["rtl"]
    script = F.when(rtl, F.when(F.regexp_extract(text, r"[\p{L}]", 0).rlike(HEBREW), "NotoSansHebrew").otherwise("NotoSansArabic"))
    family = F.nullif(F.coalesce(face, part, script), F.lit(""))
    kind = F.when(face.isin(*loaded) if loaded else F.lit(False), "exact").when(family.isNotNull(), "named").otherwise("unknown")
    return F.struct(family.alias("family"), kind.alias("kind"), name.rlike("bold|black").alias("bold"), name.rlike("italic|oblique").alias("italic"))


def relative_size(points: Column, page_height: Column, box_height: Column) -> Column:
    """Struct (size, estimated): a share of the page's height, from points where both are known, else 0.85 of the box."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    known = F.coalesce((points > 0) & (page_height > 0) & finite(points) & finite(page_height), F.lit(False))
    box = F.when((box_height > 0) & finite(box_height), box_height * 0.85).otherwise(0.0)
    return F.struct(F.when(known, points / page_height).otherwise(box).alias("size"), (~known).alias("estimated"))


NAMES = [(i, n, t) for i, (n, t) in enumerate([("/ABCDEF+NotoSans-Bold", "a"), ("notosansarabic-regular", "a"), ("Vazir-Medium", "a"), ("CourierNew-Oblique", "a"), ("LiberationSans-Bold", "a"), ("LiberationSerif", "a"), ("ABCDEF+TimesNewRoman,BoldItalic", "a"), (None, "שלום"), ("Helvetica", "مرحبا"), ("Helvetica", "plain"), ("", ""), ("  /Georgia ", "x"), ("ABCDE+Mono", "x"), ("NotoSansArabicX", "x")])]


def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal names, and names of parts' brands behind subset prefixes and before styles."""
    k = F.col("p_partkey")
    own = lambda c: F.get(F.array(*[F.lit(r[c]) for r in NAMES]), (k % len(NAMES)).cast("int"))
    prefix = F.when(k % 3 == 0, "/QWERTY+").when(k % 3 == 1, "/").otherwise("")
    style = F.when(k % 5 == 0, "-BoldOblique").when(k % 5 == 1, "-Black").otherwise("")
    parts = read(spark, sf_dir, "part").select((k + 1000).alias("id"), F.concat(prefix, F.coalesce(own(1), "p_brand"), style).alias("font"), F.coalesce(own(2), "p_name").alias("text"))
    rows = frame(spark, NAMES, "id long, font string, text string").unionByName(parts)
    return rows.select("id", font_name(F.col("font")).alias("name"), font_style(F.col("font"), F.col("text"), ["NotoSans"]).alias("s")).select("id", "name", "s.*")


QUERIES = {"font_styles": font_styles}
_CASES = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{f}'" for p, f in PARTS)
_FACES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FACES.items())
_I = f"p_partkey % {len(NAMES)}"
_MORE = f"SELECT p_partkey + 1000, CASE p_partkey % 3 WHEN 0 THEN '/QWERTY+' WHEN 1 THEN '/' ELSE '' END || coalesce({pick(NAMES, 1, _I)}, p_brand) || CASE p_partkey % 5 WHEN 0 THEN '-BoldOblique' WHEN 1 THEN '-Black' ELSE '' END, coalesce({pick(NAMES, 2, _I)}, p_name) FROM part"
ORACLE_SQL = {
    "font_styles": f"""WITH f AS (SELECT id, regexp_replace(regexp_replace(trim(coalesce(font, '')), '^/', ''), '^[A-Z]{{6}}\\+', '') AS name, text FROM {values_and(NAMES, 'id, font, text', 't', _MORE)}),
 g AS (SELECT *, lower(name) AS n FROM f), h AS (SELECT *, CASE n {_FACES} END AS face, coalesce(CASE n {_FACES} END, CASE {_CASES} END, CASE WHEN text = 'שלום' THEN 'NotoSansHebrew' WHEN text = 'مرحبا' THEN 'NotoSansArabic' END) AS fam FROM g)
 SELECT CAST(id AS BIGINT) AS id, name, nullif(fam, '') AS family, CASE WHEN face = 'NotoSans' THEN 'exact' WHEN nullif(fam, '') IS NOT NULL THEN 'named' ELSE 'unknown' END AS kind, regexp_matches(n, 'bold|black') AS bold, regexp_matches(n, 'italic|oblique') AS italic FROM h""",
}
