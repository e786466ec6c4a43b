"""Photo library rows: cleaning, description and keyword-scored search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.operators.ordering import top_k
from quarry.session import materialize


def _filled(names: str) -> Column:
    return F.filter(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda x: x != "")


def photo_rows(raw: DataFrame) -> DataFrame:
    """Usable photos: those with a path, blank names removed, file name with fallbacks."""
    return raw.filter(F.coalesce(F.col("file_path"), F.lit("")) != "").withColumns(
        {
            "file_name": F.coalesce(
                F.nullif(F.col("file_name"), F.lit("")), F.nullif(F.col("original_name"), F.lit("")), F.lit("Unknown")
            ),
            "keywords": F.coalesce(F.col("keywords"), F.array().cast("array<string>")),
            "persons": _filled("persons"),
            "album_names": _filled("album_names"),
        }
    ).drop("original_name")


def photo_location(name: Column, city: Column, country: Column, lat: Column, lon: Column) -> Column:
    """Place parts joined; coordinates only when there is no place at all."""
    place = F.coalesce(name, city, country)
    parts = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in (name, city, country)])
    coordinates = F.format_string("%.2f, %.2f", lat, lon)
    return (
        F.when(place.isNotNull(), parts)
        .when(lat.isNotNull() & lon.isNotNull(), coordinates)
        .otherwise("")
    )


def photo_text() -> Column:
    """A photo described in words, from persons, keywords, location and date."""
    who = F.when(F.size("persons") > 0, F.concat(F.lit("Photo of "), F.array_join("persons", " and "))).otherwise("Photo")
    return F.concat_ws(
        " ",
        who,
        F.when(F.size("keywords") > 0, F.array_join("keywords", " ")),
        F.when(F.col("location") != "", F.concat(F.lit("at "), F.col("location"))),
        F.when(F.col("date").isNotNull(), F.concat(F.lit("on "), F.date_format("date", "MMMM yyyy"))),
    )


def _substrings(token: Column, lengths: list[int]) -> Column:
    """All substrings of a token that have one of the given lengths."""
    lens = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(token))
    return F.flatten(
        F.transform(lens, lambda n: F.transform(
            F.sequence(F.lit(1), F.length(token) - n + 1), lambda p: F.substring(token, p, n)
        ))
    )


def match_points(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Points every query gives to every distinct photo token: (qid, field, token, points).

    ``vocabulary``: field, token; ``terms``: qid, term.  Substring matches are an
    equi-join on the substrings of the distinct tokens, restricted to the
    lengths that occur among the terms.
    """
    s = fv.PHOTO_SCORES
    counted = terms.filter(F.col("term") != "").groupBy("qid", "term").agg(F.count("*").alias("times"))
    lengths = sorted(r["n"] for r in counted.select(F.length("term").alias("n")).distinct().toLocalIterator())
    if not lengths:
        return vocabulary.select(F.lit(None).alias("qid"), "field", "token", F.lit(0).alias("points")).limit(0)
    pieces = vocabulary.filter(F.col("field") != "album").select(
        "field", "token", F.explode(F.array_distinct(_substrings(F.col("token"), lengths))).alias("term")
    )
    partial = pieces.join(counted, "term").groupBy("qid", "field", "token").agg(
        F.sum("times").alias("contained"), F.max((F.col("term") == F.col("token")).cast("int")).alias("exact")
    )
    exact = F.col("exact") == 1
    points = (
        F.when(F.col("field") == "keyword", F.when(exact, s["keyword"]).otherwise(s["keyword_part"]))
        .when(F.col("field") == "person", F.when(exact, s["person"]).otherwise(s["person_part"]))
        .otherwise(F.col("contained") * s["location"])
    )
    albums = vocabulary.filter(F.col("field") == "album").join(
        counted.withColumnRenamed("term", "token"), "token"
    )
    return partial.select("qid", "field", "token", points.cast("bigint").alias("points")).unionByName(
        albums.select("qid", "field", "token", F.lit(s["album"]).cast("bigint").alias("points"))
    )


#: Photos and queries of one tile.
PHOTO_TILE, QUERY_TILE = 1 << 14, 1 << 12


def _tile_scorer(k: int, key: str):
    """The function of a group: postings of a tile of photos and the points of a tile of queries in, the k best photos of
    each query out, by score, newest date and key."""

    def score(postings: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        columns = ["qid", key, "date", "score"]
        if postings.empty or points.empty:
            return pd.DataFrame({c: [] for c in columns})
        photos, place = np.unique(postings[key].to_numpy(), return_inverse=True)
        when = np.full(len(photos), _NO_DATE)
        dates = postings["date"].to_numpy()
        known = ~pd.isna(dates)
        np.maximum.at(when, place[known], dates[known].astype(np.int64))
        lists = {name: (place[at], postings["times"].to_numpy(np.int64)[at]) for name, at in postings.groupby(["field", "token"]).indices.items()}
        parts = []
        for qid, mine in points.groupby("qid", sort=False):
            held = [(*lists[f, t], p) for f, t, p in zip(mine["field"], mine["token"], mine["points"]) if (f, t) in lists]
            if held:
                where = np.concatenate([at for at, _, _ in held])
                total = np.bincount(where, np.concatenate([times * p for _, times, p in held]), len(photos)).astype(np.int64)
                hits = np.flatnonzero(total > 0)
                best = hits[np.lexsort((hits, -when[hits], -total[hits]))][:k]
                parts.append(pd.DataFrame({"qid": [qid] * len(best), key: photos[best], "date": when[best], "score": total[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in columns})

    return score


def photo_hits(photos: DataFrame, terms: DataFrame, k: int = 20, key: str = "file_path", tile: int = PHOTO_TILE) -> DataFrame:
    """The k best photos of every query in every tile of photos: (qid, key, date in micros, score).

    A word that very many photos have meets a query once a tile, not once a photo: its postings lie in the tiles, and each
    tile lets at most k rows of a query out.
    """
    values = F.array(
        F.struct(F.lit("keyword").alias("field"), F.col("keywords").alias("names")),
        F.struct(F.lit("person").alias("field"), F.col("persons").alias("names")),
        F.struct(F.lit("location").alias("field"), F.array("location").alias("names")),
        F.struct(F.lit("album").alias("field"), F.col("album_names").alias("names")),
    )
    tokens = (
        photos.select(key, "date", F.explode(values).alias("v"))
        .select(key, "date", F.col("v.field").alias("field"), F.explode("v.names").alias("token"))
        .select(key, F.unix_micros("date").alias("date"), "field", F.lower("token").alias("token"))
        .filter(F.col("token") != "")
    )
    points = materialize(match_points(tokens.select("field", "token").distinct(), terms), "points")
    name = ["field", "token"]
    tiles = max(1, -(-photos.count() // tile))
    postings = tokens.join(points.select(*name).distinct(), name, "left_semi").groupBy(key, *name).agg(
        F.count("*").alias("times"), F.max("date").alias("date")).withColumn("_tile", F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int"))
    postings = materialize(postings, "postings")
    blocks = max(1, -(-points.select("qid").distinct().count() // QUERY_TILE))
    asked = points.join(postings.select(F.col("_tile").alias("_in"), *name).distinct(), name).withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    dealt = postings.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = f"qid {points.schema['qid'].dataType.simpleString()}, {key} {photos.schema[key].dataType.simpleString()}, date bigint, score bigint"
    return dealt.groupBy("_tile", "_block").cogroup(asked.groupBy("_in", "_block")).applyInPandas(_tile_scorer(k, key), schema)


def search_photos(photos: DataFrame, terms: DataFrame, k: int = 20, key: str = "file_path", tile: int = PHOTO_TILE) -> DataFrame:
    """Keyword-scored top-k per query: (qid, key, date, score, rank), best score first, newest first."""
    found = photo_hits(photos, terms, k, key, tile)
    dated = found.withColumn("date", F.timestamp_micros(F.when(F.col("date") > _NO_DATE, F.col("date"))))
    return top_k(dated, ["qid"], [F.desc("score"), F.desc_nulls_last("date"), F.asc(key)], k)


#: Instead of the date of a photo without one.
_NO_DATE = -(2**62)
