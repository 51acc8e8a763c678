"""Loading benchmark files, shaping them into tables and graphs, and generating data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the pipe-separated benchmark files, fixed values of their format; dates stay text there.
TPCH = {
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-separated text with a known schema (the separator at the end of each line is no column)."""
    return spark.read.csv(path, sep="|", schema=schema)


def sniffed_separator(spark: SparkSession, path: str, candidates: Sequence[str] = ("|", "\t", ";", ",")) -> str:
    """The candidate that the first line holds most often."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max(candidates, key=lambda s: (line.count(s), -candidates.index(s)))


def read_headerless(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Text without header: types inferred, a last column that is null throughout dropped, names c0, c1, ..."""
    df = spark.read.csv(path, sep=separator or sniffed_separator(spark, path), inferSchema=True)
    last = df.columns[-1]
    if len(df.columns) > 1 and df.where(F.col(last).isNotNull()).isEmpty():
        df = df.drop(last)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def read_with_header(spark: SparkSession, path: str, separator: str = "|", schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, sep=separator, header=True, schema=schema)


def written(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def written_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


# Social network layouts


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


# The official layouts' names for what the queries call otherwise, fixed values of the format.
OFFICIAL = {
    "person": ("Person", {"id": "person_id", "firstName": "name", "LocationCityId": "city"}),
    "posts": ("Post", {"id": "post_id", "CreatorPersonId": "creator_id", "length": "content_length", "creationDate": "creation_date"}),
    "comments": ("Comment", {"id": "comment_id", "CreatorPersonId": "author_id", "ParentPostId": "post_id", "length": "content_length"}),
    "works_at": ("Person_workAt_Company", {"PersonId": "person_id", "CompanyId": "organisation_id"}),
    "knows": ("Person_knows_Person", {"Person1Id": "src", "Person2Id": "dst"}),
}


def official_network(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an official social network folder: ``<folder>/<Entity>`` as Parquet, or as CSV with headers and pipes."""

    def read(entity: str) -> DataFrame:
        path = f"{folder}/{entity}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = [f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)]
        if any(n.endswith(".parquet") for n in there):
            return spark.read.parquet(path)
        return spark.read.csv(path, sep="|", header=True, inferSchema=True)

    found = {name: renamed(read(entity), names) for name, (entity, names) in OFFICIAL.items()}
    found["knows"] = symmetric(found["knows"].select("src", "dst", F.lit("KNOWS").alias("relationship")))
    found["works_at"] = enriched_works_at(found["works_at"])
    return found | {"messages": messages(found["posts"], found["comments"])}


def knows_edges(df: DataFrame, label: str = "KNOWS") -> DataFrame:
    """The first two columns as src and dst."""
    a, b = df.columns[:2]
    return df.select(F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst"), F.lit(label).alias("relationship"))


def messages(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts and comments under one set of names, with repeats kept."""
    one = lambda df, key, by: df.select(F.col(key).alias("message_id"), F.col(by).alias("sender_id"), "content_length")
    return one(posts, "post_id", "creator_id").unionByName(one(comments, "comment_id", "author_id"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, each once."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Every id at an end of an edge, once."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def vertices_of(edges: DataFrame, person: DataFrame | None = None, key: str = "person_id") -> DataFrame:
    """Vertices with the attributes of a person table, else the bare endpoints."""
    return endpoints(edges) if person is None else person.withColumn("id", F.col(key)).dropDuplicates(["id"])


def projected_edges(df: DataFrame, left: str, right: str, label: str | Column = "LINKED", left_table: str = "", right_table: str = "") -> DataFrame:
    """Edges between the values of two columns, as ``table:column:value`` texts; rows with a null give none."""
    end = lambda t, c: F.concat(F.lit(f"{t}:{c}:" if t else ""), F.col(c).cast("string"))
    relationship = F.lit(label) if isinstance(label, str) else label
    edges = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return edges.select(end(left_table, left).alias("src"), end(right_table, right).alias("dst"), relationship.alias("relationship")).distinct()


def edge_list(df: DataFrame, label: str = "KNOWS") -> DataFrame:
    """A citation graph's index pairs as edges, each pair once."""
    return knows_edges(df, label).dropDuplicates(["src", "dst"])


def edge_index(arrays: DataFrame, column: str = "edge_index", label: str = "KNOWS") -> DataFrame:
    """The edges of an ``edge_index``, two arrays of which one holds the sources and the other the targets."""
    pair = F.arrays_zip(F.col(column)[0].alias("src"), F.col(column)[1].alias("dst"))
    return edge_list(arrays.select(F.explode(pair).alias("p")).select("p.src", "p.dst"), label)


# Which columns of a benchmark's headerless tables are linked by edges: (table, column, column, the tables that they
# are keys of, label).
PROJECTIONS = {
    "job": (("cast_info", "c1", "c2", "name", "title", "CAST"), ("movie_companies", "c1", "c2", "title", "company_name", "PRODUCED_BY")),
    "tpcds": (("store_sales", "c3", "c2", "customer", "item", "BOUGHT"), ("web_sales", "c4", "c3", "customer", "item", "BOUGHT")),
}


def projected_graph(read: Callable[[str], DataFrame], links: Sequence[tuple[str, str, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the links' tables, each edge once; vertices are ``table:key:value`` texts."""
    edges = None
    for table, left, right, left_of, right_of, label in links:
        rows = read(table).select(F.col(left).alias("key_a"), F.col(right).alias("key_b"))
        end = lambda of, c: F.concat(F.lit(f"{of}:key:"), F.col(c).cast("string"))
        one = rows.where("key_a is not null and key_b is not null").select(end(left_of, "key_a").alias("src"), end(right_of, "key_b").alias("dst"), F.lit(label).alias("relationship"))
        edges = one if edges is None else edges.unionByName(one)
    edges = edges.distinct()
    return endpoints(edges), edges


# Generators: deterministic by hashes, so a row is the same whatever the partitioning


def hashed(salt: int | str, *of: str | Column) -> Column:
    """48 bits of the MD5 of a salt and columns as text, joined by colons."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("none")) for c in of]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(salt)), *text)), 1, 12), 16, 10).cast("long")


def _pick(salt: str, n: int, *of: Column) -> Column:
    return F.pmod(hashed(salt, *of), F.lit(n))


def power_law_graph(spark: SparkSession, vertices: int, degree: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, attr1) and KNOWS edges in which each vertex links to max(1, degree // 2) earlier ones.

    A target is the vertex number times a squared uniform draw, so early vertices are hubs.
    """
    out = max(1, degree // 2)
    v = spark.range(vertices).select("id", _pick(f"attr{seed}", 100, F.col("id")).cast("int").alias("attr1"))
    draw = _pick(f"edge{seed}", 1 << 30, F.col("src"), F.col("k")) / F.lit(float(1 << 30))
    e = (
        spark.range(1, vertices).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(out))).alias("k"))
        .select("src", F.floor(F.col("src") * draw * draw).cast("long").alias("dst"), F.lit("KNOWS").alias("relationship"))
        .distinct()
    )
    return v, e


def social_network(spark: SparkSession, persons: int, seed: int = 42) -> dict[str, DataFrame]:
    """person, posts, comments, messages, works_at and knows in the shape of a small social network."""
    cities, countries = ["Berlin", "Paris", "Madrid", "Rome", "London"], ["Germany", "France", "Spain", "Italy", "UK"]
    at = lambda values, salt, *of: F.element_at(F.array(*map(F.lit, values)), (_pick(f"{salt}{seed}", len(values), *of) + 1).cast("int"))
    key = F.col("person_id")
    person = spark.range(persons).select(F.col("id").cast("int").alias("person_id")).select(
        "person_id", F.concat(F.lit("Person_"), key).alias("name"), at(cities, "place", key).alias("city"), at(countries, "place", key).alias("country"),
        (18 + _pick(f"age{seed}", 60, key)).cast("int").alias("age"),
    )
    who = lambda salt: _pick(f"{salt}{seed}", persons, F.col("id")).cast("int")
    day = F.date_add(F.lit("2020-01-01").cast("date"), _pick(f"day{seed}", 1000, F.col("id")).cast("int")).cast("string")
    posts = spark.range(persons * 5).select(F.col("id").cast("int").alias("post_id"), who("post").alias("creator_id"), (10 + _pick("len", 490, F.col("id"))).cast("int").alias("content_length"), day.alias("creation_date"))
    comments = spark.range(persons * 8).select(
        F.col("id").cast("int").alias("comment_id"), who("comment").alias("author_id"), _pick("of", persons * 5, F.col("id")).cast("int").alias("post_id"), (5 + _pick("clen", 195, F.col("id"))).cast("int").alias("content_length")
    )
    works = person.select("person_id", F.concat(F.lit("Company_"), _pick(f"job{seed}", 50, key)).alias("company_name"))
    knows = spark.range(persons * 10).select(F.col("id").alias("k"), who("a").cast("int").alias("src"), _pick("b", persons, F.col("id") + 7).cast("int").alias("dst"))
    edges = knows.where("src <> dst").select("src", "dst", F.lit("KNOWS").alias("relationship")).distinct()
    return {"person": person, "posts": posts, "comments": comments, "messages": messages(posts, comments), "works_at": works, "knows": edges}


# Compatibility tables


def _from_list(values: Sequence[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def compatible_customer(customer: DataFrame, key: str = "c0", most: int | None = None) -> DataFrame:
    """A customer table made by rule from a table that only has the key."""
    k = F.col(key).cast("long")
    made = customer.where(k.isNotNull()).select(
        k.alias("c_custkey"), F.concat(F.lit("Customer#"), k.cast("string")).alias("c_name"), F.pmod(k, F.lit(25)).cast("int").alias("c_nationkey"),
        (F.pmod(k * 37, F.lit(10_000)).cast("double")).alias("c_acctbal"), _from_list(SEGMENTS, k).alias("c_mktsegment"),
    )
    return made if most is None else made.limit(most)


def compatible_orders(sales: DataFrame, key: str = "c3", price: str = "c20", most: int | None = None, number: str | None = None) -> DataFrame:
    """An orders table made by rule from sales rows with a customer key and an amount.

    The column ``number`` is the order's key; without one orders are numbered by partition and place, with gaps.
    """
    own = F.monotonically_increasing_id() + 1 if number is None else F.col(number).cast("long")
    made = sales.where(F.col(key).isNotNull()).select(own.alias("o_orderkey"), F.col(key).cast("long").alias("o_custkey"), F.coalesce(F.col(price).cast("double"), F.lit(0.0)).alias("o_totalprice"))
    made = made.select("o_orderkey", "o_custkey", "o_totalprice", _from_list(PRIORITIES, F.col("o_orderkey")).alias("o_orderpriority"), _from_list(STATUSES, F.col("o_orderkey")).alias("o_orderstatus"))
    return made if most is None else made.limit(most)


def enriched_works_at(works_at: DataFrame) -> DataFrame:
    """company_name from organisation_id where it is missing."""
    if "company_name" in works_at.columns or "organisation_id" not in works_at.columns:
        return works_at
    return works_at.withColumn("company_name", F.col("organisation_id").cast("string"))


def enriched_person(person: DataFrame, vertices: DataFrame, key: str = "person_id") -> DataFrame:
    """country from the vertex table where the person table has none."""
    if "country" in person.columns or "country" not in vertices.columns:
        return person
    there = key if key in vertices.columns else "id"
    known = vertices.groupBy(F.col(there).alias(key)).agg(F.min("country").alias("country"))
    return person.join(known, key, "left")


def column_types(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]
