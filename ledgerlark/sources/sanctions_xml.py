"""Sanctions lists in XML, read by Spark's own reader with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Part types of a location in the advanced format.
PARTS = {"1451": "address", "1452": "address", "1453": "address", "1454": "city", "1455": "state_province", "1456": "postal_code"}

_NAME_PART = "array<struct<NamePartValue:struct<_VALUE:string>>>"
_PARTY = f"""_FixedRef string, Profile struct<_ID:string,_PartySubTypeID:string,Identity:array<struct<Alias:array<struct<_AliasTypeID:string,_Primary:string,_LowQuality:string,
  DocumentedName:array<struct<DocumentedNamePart:{_NAME_PART}>>>>>>>"""
_LOCATION = "_ID string, LocationCountry array<struct<_CountryID:string>>, LocationPart array<struct<_LocPartTypeID:string,LocationPartValue:array<struct<Value:string>>>>"
_MEASURES = "_ProfileID string, SanctionsMeasure array<struct<Comment:string>>"
# Lookups stand together in one short element.
_LOOKUPS = ", ".join(f"{tag}Values struct<{tag}:array<struct<_ID:string,_VALUE:string>>>" for tag in ("AliasType", "PartySubType", "Country"))


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.option("rowTag", tag).option("ignoreNamespace", "true").option("attributePrefix", "_").option("valueTag", "_VALUE").schema(schema).xml(path)


def load_sdn_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, aliases, locations) of the advanced format. Names are their parts, joined; the primary name is the first
    primary alias, else the first; programs are the distinct comments of measures of at most 40 characters, in order. The
    reader splits the file by one kind of element at a time: parties, measures, locations, and the lookups of all kinds."""
    party = _read(spark, path, "DistinctParty", _PARTY)
    sets = _read(spark, path, "ReferenceValueSets", _LOOKUPS)
    lookup = lambda tag, name: sets.select(F.inline(f"{tag}Values.{tag}")).select(F.col("_ID").alias(f"_{tag}ID"), F.col("_VALUE").alias(name))
    alias_types, kinds, countries = lookup("AliasType", "alias_type"), lookup("PartySubType", "entity_type"), lookup("Country", "country")
    flat = F.flatten(F.transform("Profile.Identity", lambda i: i["Alias"]))
    a = party.select(F.col("_FixedRef").alias("fixed_ref"), F.posexplode(flat).alias("place", "a"))
    words = F.flatten(F.transform("a.DocumentedName", lambda d: F.transform(d["DocumentedNamePart"], lambda p: p["NamePartValue"]["_VALUE"])))
    yes = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    aliases = a.select("fixed_ref", "place", F.concat_ws(" ", F.filter(words, lambda w: w.isNotNull())).alias("alias_name"), F.col("a._AliasTypeID").alias("_AliasTypeID"), yes(F.col("a._Primary")).alias("is_primary"), yes(F.col("a._LowQuality")).alias("low_quality"))
    aliases = aliases.filter("alias_name <> ''").join(F.broadcast(alias_types), "_AliasTypeID", "left").drop("_AliasTypeID")
    primary = aliases.groupBy("fixed_ref").agg(F.min_by("alias_name", F.struct(~F.col("is_primary"), "place")).alias("primary_name"))
    comments = _read(spark, path, "SanctionsEntry", _MEASURES).select(F.col("_ProfileID").alias("fixed_ref"), F.array_distinct(F.filter(F.transform("SanctionsMeasure", lambda m: m["Comment"]), lambda c: c.isNotNull() & (F.length(c) <= 40) & (c != ""))).alias("programs"))
    programs = comments.groupBy("fixed_ref").agg(F.array_distinct(F.flatten(F.collect_list("programs"))).alias("programs"))
    base = party.select(F.col("_FixedRef").alias("fixed_ref"), F.col("Profile._PartySubTypeID").alias("_PartySubTypeID")).join(F.broadcast(kinds), "_PartySubTypeID", "left")
    entries = base.join(primary, "fixed_ref", "left").join(programs, "fixed_ref", "left").select("fixed_ref", "primary_name", "entity_type", F.coalesce("programs", F.array().cast("array<string>")).alias("programs"), F.lit("SDN").alias("list_name"))
    place = _read(spark, path, "Location", _LOCATION)

    def part(name: str) -> Column:
        ids = [k for k, v in PARTS.items() if v == name]
        mine = F.filter("LocationPart", lambda p: p["_LocPartTypeID"].isin(ids))
        return F.concat_ws(", ", F.flatten(F.transform(mine, lambda p: F.transform(p["LocationPartValue"], lambda v: v["Value"])))).alias(name)

    locations = place.select(F.col("_ID").alias("location_id"), F.col("LocationCountry")[0]["_CountryID"].alias("_CountryID"), *(part(n) for n in dict.fromkeys(PARTS.values()))).join(F.broadcast(countries), "_CountryID", "left").drop("_CountryID")
    return entries, aliases, locations


_ADDRESS = "array<struct<CITY:string,COUNTRY:string,STATE_PROVINCE:string,NOTE:string>>"
_ALIAS = "array<struct<QUALITY:string,ALIAS_NAME:string>>"


def load_un_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries, aliases, locations, identifiers) of the consolidated format; identifiers are of individuals only."""
    parts = []
    for tag in ("INDIVIDUAL", "ENTITY"):
        names = "FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string"
        rows = _read(spark, path, tag, f"DATAID string, {names}, UN_LIST_TYPE string, {tag}_ALIAS {_ALIAS}, {tag}_ADDRESS {_ADDRESS}, INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string>>")
        name = F.concat_ws(" ", *(F.when(F.trim(c) != "", F.trim(c)) for c in (("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME") if tag == "INDIVIDUAL" else ("FIRST_NAME",))))
        document = F.col("INDIVIDUAL_DOCUMENT") if tag == "INDIVIDUAL" else F.lit(None).cast("array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string>>")
        parts.append(rows.select(F.concat(F.lit("UN-"), "DATAID").alias("fixed_ref"), name.alias("primary_name"), F.lit(tag.title()).alias("entity_type"), F.array("UN_LIST_TYPE").alias("programs"), F.col(f"{tag}_ALIAS").alias("a"), F.col(f"{tag}_ADDRESS").alias("p"), document.alias("d")))
    rows = parts[0].unionByName(parts[1]).filter("primary_name <> ''")
    entries = rows.select("fixed_ref", "primary_name", "entity_type", "programs", F.lit("UN").alias("list_name"))
    main = rows.select("fixed_ref", F.col("primary_name").alias("alias_name"), F.lit("Name").alias("alias_type"), F.lit(True).alias("is_primary"), F.lit(False).alias("low_quality"))
    other = rows.select("fixed_ref", "primary_name", F.explode("a").alias("x")).filter((F.trim("x.ALIAS_NAME") != "") & (F.trim("x.ALIAS_NAME") != F.col("primary_name")))
    aliases = main.unionByName(other.select("fixed_ref", F.trim("x.ALIAS_NAME").alias("alias_name"), F.lit("A.K.A.").alias("alias_type"), F.lit(False).alias("is_primary"), F.coalesce(F.lower("x.QUALITY") == "low", F.lit(False)).alias("low_quality")))
    known = F.filter("p", lambda x: F.coalesce(x["CITY"], x["COUNTRY"], x["STATE_PROVINCE"]).isNotNull())
    locations = rows.select("fixed_ref", F.get(known, F.lit(0)).alias("x")).filter("x IS NOT NULL").select("fixed_ref", F.col("x.COUNTRY").alias("country"), F.col("x.CITY").alias("city"), F.col("x.STATE_PROVINCE").alias("state_province"), F.col("x.NOTE").alias("address"))
    identifiers = rows.select("fixed_ref", F.explode("d").alias("x")).filter("x.NUMBER IS NOT NULL").select("fixed_ref", F.col("x.TYPE_OF_DOCUMENT").alias("id_type"), F.col("x.NUMBER").alias("id_value"), F.col("x.ISSUING_COUNTRY").alias("country"))
    return entries, aliases, locations, identifiers
