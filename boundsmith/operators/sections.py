"""Cutting a description into sections: parcels, easements, exhibits, commencement.

Works inside the row: a mark is put before every header, the text is split at the
marks, and marks in the middle of a sentence are taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.functions.text import clean_label

# Header and beginning phrases; easements come first.
_EASEMENT = r"(?:NON[-\s]?EXCLUSIVE\s+EASEMENT)|(?:ACCESS\s+EASEMENT)|(?:EASEMENT\s+PARCEL(?:\s+(?:NO\.?\s+)?(?:\d+|[A-Z]\b))?)"
_EXHIBIT = r"EXHIBIT\s+[A-Z0-9]+\b"
_PARCEL = r"PARCEL\s+(?:NO\.?\s+)?(?:\d+|[A-Z]\b|ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)\b\s*:?"
HEADER = rf"(?i)(?:{_EASEMENT}|{_EXHIBIT}|{_PARCEL})"
TRUE_BEGINNING = r"(?i)(?:THE\s+)?TRUE\s+POINT\s+OF\s+BEGINNING(?:\s+OF\s+THE\s+BOUNDARY)?|POINT\s+OF\s+BEGINNING\s+OF\s+THE\s+BOUNDARY"
_MARK = "\u0001"


def _sums(pieces: Column) -> Column:
    return F.transform(pieces, lambda p, i: F.aggregate(F.slice(F.transform(pieces, F.length), F.lit(1), i), F.lit(0), lambda a, x: a + x))


def split_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, sec_no, label, section_type, text, start, end``; blank texts have none.

    Sections are contiguous: their texts in order are the input again.
    """
    text = F.col("source_text")
    rows = docs.select("doc_id", "source_text").where(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")) != "")
    rows = rows.withColumn("pieces", F.split(F.regexp_replace(text, f"({HEADER})", _MARK + "$1"), _MARK))
    # A header counts at the start, after a line end or after punctuation that ends a sentence.
    lead = F.filter(
        F.transform(F.arrays_zip("pieces", _sums(F.col("pieces")).alias("at")), lambda z, i: F.struct(z["at"].alias("at"), i.alias("i"))),
        lambda z: (z["i"] > 0) & ((z["at"] == 0) | F.rtrim(F.substring(text, F.lit(1), z["at"]), F.lit(" \t")).rlike(r"(?s)(?:^|[.\n;:!?])$")),
    )
    rows = rows.withColumn("heads", F.transform(lead, lambda z: z["at"].cast("int")))
    before = F.when(F.size("heads") > 0, F.substring(text, F.lit(1), F.col("heads")[0])).otherwise(text)
    phrase = F.regexp_extract(before, TRUE_BEGINNING, 0)
    rows = rows.withColumn("pob", F.when(phrase != "", F.instr(before, phrase) - 1 + F.length(phrase)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.col("heads"), F.filter(F.array("pob"), lambda p: p.isNotNull()))))
    rows = rows.withColumn("cuts", F.filter(cuts, lambda c: c < F.length(text)))

    def section(c: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at("cuts", i + 2), F.length(text))
        head = F.array_contains("heads", c)
        own = F.substring(text, c + 1, end - c)
        header = F.regexp_extract(own, f"^{HEADER}", 0)
        kind = (
            F.when(head & header.rlike(f"^(?i:{_EASEMENT})"), "easement").when(head & header.rlike(f"^(?i:{_EXHIBIT})"), "exhibit").when(head, "parcel")
            .when((c == 0) & F.col("pob").isNotNull(), "commencement").when(c == 0, "boilerplate").otherwise("unknown")
        )
        label = F.when(head, clean_label(header)).when(kind == "commencement", "COMMENCEMENT").when(kind == "boilerplate", "BOILERPLATE").otherwise("BOUNDARY")
        return F.struct(c.alias("start"), end.alias("end"), label.alias("label"), kind.alias("section_type"), own.alias("text"))

    rows = rows.withColumn("secs", F.transform("cuts", section))
    # A blank first slice joins the next one, a slice of mere punctuation the one before.
    blank = (F.size("secs") > 1) & (F.trim(F.regexp_replace(F.col("secs")[0]["text"], r"(?U)\s", "")) == "")
    second = F.try_element_at("secs", F.lit(2))
    joined = F.struct(F.lit(0).alias("start"), second["end"].alias("end"), second["label"].alias("label"), second["section_type"].alias("section_type"), F.concat(F.col("secs")[0]["text"], second["text"]).alias("text"))
    rows = rows.withColumn("secs", F.when(blank, F.concat(F.array(joined), F.slice("secs", F.lit(3), F.size("secs")))).otherwise(F.col("secs")))

    def absorb(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        bridge = last.isNotNull() & (s["section_type"] == "unknown") & s["text"].rlike(r"(?U)^[\s.;,:!?]+$")
        wider = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["label"].alias("label"), last["section_type"].alias("section_type"), F.concat(last["text"], s["text"]).alias("text"))
        return F.when(bridge, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast("array<struct<start:int,end:int,label:string,section_type:string,text:string>>")
    out = rows.select("doc_id", F.posexplode(F.aggregate("secs", empty, absorb)).alias("sec_no", "s"))
    return out.select("doc_id", "sec_no", "s.label", "s.section_type", "s.text", "s.start", "s.end")


def chosen_text(full: Column, sections: Column, index: Column) -> Column:
    """Index 0, or one without a section, means the whole text."""
    return F.when(index <= 0, full).otherwise(F.coalesce(F.try_element_at(sections, index)["text"], full))
