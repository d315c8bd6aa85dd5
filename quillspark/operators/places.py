"""Where a candidate lives: a PIN code, a labelled address, then names of places, looked up in tables that the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contact as C
from . import matcher

LOCATION = "struct<postal_code:string,raw_address:string,city:string,district:string,state:string,country:string,country_code:string>"
#: The country that is taken where nothing else is said.
COUNTRY, COUNTRY_CODE = "India", "IN"


def named_places(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``doc_id, city, state`` of the places that texts (``doc_id, text``) name, for those that name some.

    ``gazetteer`` has ``name, kind`` (city or state), ``state`` (of a city) and ``rank`` (smaller is better known). Names are
    looked up as stretches of words, the longest winning over those inside it. A name that several states have a city of
    is settled by a state that the text names too. Of the cities, one whose state is named comes first, then the first in
    the text, then the best known. The state is that of such a pair, else the first that is named, else the city's if only
    one state has a city of that name. Names of cities without a state are known as cities only.
    """
    spelt = gazetteer.select(F.array_join(matcher.words(F.col("name")), " ").alias("key"), "name", "kind", F.col("state").alias("of_state"), F.coalesce("rank", F.lit(1 << 30)).alias("rank")).where("key != ''")
    alone = spelt.where("kind = 'city'").groupBy(F.col("key").alias("_key")).agg(F.when(F.count_distinct("of_state") == 1, F.min("of_state")).alias("only_state"))
    found = matcher.match_terms(texts, spelt.select(F.col("key").alias("term")))
    found = found.join(spelt, F.col("term") == F.col("key")).drop("end", "term")
    states = found.where("kind = 'state'").groupBy("doc_id").agg(F.min_by("name", "start").alias("first_state"), F.collect_set("name").alias("states"))
    cities = found.where("kind = 'city'").join(states.select(F.col("doc_id").alias("_id"), "states"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    apart = ~F.coalesce(F.array_contains("states", F.col("of_state")), F.lit(False))
    best = F.min(F.struct(apart.alias("apart"), "start", "rank", "of_state", "name", "key")).alias("x")
    cities = cities.groupBy("doc_id").agg(best).select("doc_id", "x.*").join(alone, F.col("key") == F.col("_key"), "left")
    cities = cities.select("doc_id", F.col("name").alias("city"), F.when(~F.col("apart"), F.col("of_state")).alias("pair_state"), "only_state")
    both = cities.join(states.select(F.col("doc_id").alias("_id"), "first_state"), F.col("doc_id").eqNullSafe(F.col("_id")), "full")
    return both.select(F.coalesce("doc_id", "_id").alias("doc_id"), "city", F.coalesce("pair_state", "first_state", "only_state").alias("state"))


def locations(docs: DataFrame, pins: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """``doc_id, location`` of documents (``doc_id, text``, and ``place_text``, where names of places are looked for; without
    it, the text's first 1,000 characters). Null where nothing is known.

    In order: a PIN code in ``pins`` (postal_code, city, district, state) tells all. Else a labelled address is kept as it is,
    with the places that it names; else the places in ``place_text``. The country is ``COUNTRY`` where a PIN code or a place
    was found, but not for an address that names none. Without the tables, only codes and addresses are told.
    """
    place_text = F.col("place_text") if "place_text" in docs.columns else F.substring("text", 1, 1000)
    found = docs.select("doc_id", C.pin_code("text").alias("postal_code"), C.raw_address("text").alias("raw_address"), place_text.alias("place_text"))
    null = F.lit(None).cast("string")
    if pins is None:
        found = found.select("*", null.alias("pin_city"), null.alias("pin_district"), null.alias("pin_state"))
    else:
        known = pins.select("postal_code", F.col("city").alias("pin_city"), F.col("district").alias("pin_district"), F.col("state").alias("pin_state")).dropDuplicates(["postal_code"])
        found = found.join(known, "postal_code", "left")
    by_pin = F.coalesce("pin_city", "pin_district", "pin_state").isNotNull()
    if gazetteer is None:
        found = found.select("*", null.alias("city"), null.alias("state"))
    else:
        asked = found.where(~by_pin).select("doc_id", F.coalesce("raw_address", "place_text").alias("text")).where("text is not null")
        places = named_places(asked, gazetteer).withColumnRenamed("doc_id", "_id")
        found = found.join(places, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    named = F.coalesce("city", "state").isNotNull()
    # A code that no table has is a find, but an address is asked for its own places only.
    country = by_pin | named | (F.col("raw_address").isNull() & F.col("postal_code").isNotNull()) if gazetteer is not None else by_pin
    place = F.struct(
        "postal_code",
        F.when(~by_pin, F.col("raw_address")).alias("raw_address"),
        F.when(by_pin, F.col("pin_city")).otherwise(F.col("city")).alias("city"),
        F.when(by_pin, F.col("pin_district")).alias("district"),
        F.when(by_pin, F.col("pin_state")).otherwise(F.col("state")).alias("state"),
        F.when(country, COUNTRY).alias("country"),
        F.when(country, COUNTRY_CODE).alias("country_code"),
    )
    return found.select("doc_id", F.when(F.coalesce("postal_code", "raw_address", "city", "state").isNotNull(), place).alias("location"))
