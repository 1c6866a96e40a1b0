"""Lookup tables: names with weights, addresses, postcodes.

Schemas: addresses `(str_name, hausnr, hausnr_zus, plz, ort)`, first names `(vorname, geschlecht, anzahl)`,
last names `(nachname, anzahl)`, postcodes `(plz_postleitzahl, gemeinde_name, kanton_name, kanton_name_kurz)`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.draws import below, one_of
from maskflow.operators.slots import Slots, build_slots
from maskflow.sources.cache import cached, files_at, fingerprint, is_there
from maskflow.sources.files import read_csv

ADDRESS_SCHEMA = "str_name string, hausnr int, hausnr_zus string, plz int, ort string"
FIRST_NAME_SCHEMA = "vorname string, geschlecht string, anzahl int"
LAST_NAME_SCHEMA = "nachname string, anzahl int"
POSTCODE_SCHEMA = "plz_postleitzahl int, gemeinde_name string, kanton_name string, kanton_name_kurz string, ord long"

# The entry that stands for all other names in a name statistic.
REST_NAME = "übrige"

# Sample data: common given names, surnames, streets and places with invented weights.
MALE_NAMES = [
    "Adrian", "Alexander", "Andreas", "Beat", "Bruno", "Christian", "Daniel", "David", "Fabian", "Felix",
    "Hans", "Jan", "Jonas", "Kevin", "Lars", "Lukas", "Marco", "Markus", "Martin", "Michael",
    "Nicolas", "Noah", "Patrick", "Peter", "Reto", "Roland", "Samuel", "Simon", "Stefan", "Thomas",
]
FEMALE_NAMES = [
    "Alina", "Andrea", "Anna", "Barbara", "Claudia", "Corinne", "Daniela", "Elena", "Emma", "Esther",
    "Eva", "Fabienne", "Franziska", "Julia", "Karin", "Lara", "Laura", "Lea", "Lena", "Livia",
    "Maria", "Mia", "Monika", "Nadine", "Nicole", "Petra", "Sandra", "Sara", "Sophie", "Ursula",
]
LAST_NAMES = [
    "Baumann", "Berger", "Bieri", "Brunner", "Bühler", "Egli", "Fischer", "Frei", "Frey", "Gerber",
    "Graf", "Grob", "Hofer", "Huber", "Hug", "Kaufmann", "Keller", "Koch", "Kunz", "Lang",
    "Lehmann", "Leu", "Marti", "Maurer", "Meier", "Meyer", "Moser", "Müller", "Peter", "Roth",
    "Schmid", "Schneider", "Schwarz", "Steiner", "Suter", "Weber", "Widmer", "Wyss", "Zimmermann", "von Allmen",
]
STREETS = [
    "Ahornweg", "Bachstrasse", "Bahnhofstrasse", "Birkenweg", "Blumenweg", "Brunngasse", "Dorfstrasse",
    "Eichenweg", "Feldstrasse", "Gartenstrasse", "Hauptstrasse", "Kirchgasse", "Lindenweg", "Marktgasse",
    "Mühleweg", "Rosenweg", "Schulstrasse", "Seestrasse", "Sonnenweg", "Waldstrasse",
]
PLACES = [
    (4001, "Basel", "Basel-Stadt", "BS"), (4051, "Basel", "Basel-Stadt", "BS"), (4052, "Basel", "Basel-Stadt", "BS"),
    (4054, "Basel", "Basel-Stadt", "BS"), (4057, "Basel", "Basel-Stadt", "BS"), (4125, "Riehen", "Basel-Stadt", "BS"),
    (4126, "Bettingen", "Basel-Stadt", "BS"), (4102, "Binningen", "Basel-Landschaft", "BL"),
    (4123, "Allschwil", "Basel-Landschaft", "BL"), (4132, "Muttenz", "Basel-Landschaft", "BL"),
    (4410, "Liestal", "Basel-Landschaft", "BL"), (3001, "Bern", "Bern", "BE"), (3011, "Bern", "Bern", "BE"),
    (2502, "Biel", "Bern", "BE"), (3600, "Thun", "Bern", "BE"), (8001, "Zürich", "Zürich", "ZH"),
    (8004, "Zürich", "Zürich", "ZH"), (8400, "Winterthur", "Zürich", "ZH"), (6003, "Luzern", "Luzern", "LU"),
    (5000, "Aarau", "Aargau", "AG"), (9000, "St. Gallen", "St. Gallen", "SG"), (7000, "Chur", "Graubünden", "GR"),
    (6900, "Lugano", "Ticino", "TI"), (1201, "Genève", "Genève", "GE"), (1003, "Lausanne", "Vaud", "VD"),
    (1950, "Sion", "Valais", "VS"), (2000, "Neuchâtel", "Neuchâtel", "NE"), (1700, "Fribourg", "Fribourg", "FR"),
]


def _literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that lives in the plan."""
    shown = ", ".join(
        "(" + ", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    fields = [f.strip().split(" ") for f in schema.split(",")]
    table = spark.sql(f"SELECT * FROM VALUES {shown} AS t({', '.join(n for n, _ in fields)})")
    return table.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def sample_first_names(spark: SparkSession) -> DataFrame:
    rows = [(n, "M", 5 + (7 * i) % 40) for i, n in enumerate(MALE_NAMES)]
    rows += [(n, "W", 5 + (11 * i) % 40) for i, n in enumerate(FEMALE_NAMES)]
    return _literal_rows(spark, rows, FIRST_NAME_SCHEMA)


def sample_last_names(spark: SparkSession) -> DataFrame:
    return _literal_rows(spark, [(n, 3 + (13 * i) % 60) for i, n in enumerate(LAST_NAMES)], LAST_NAME_SCHEMA)


def sample_postcodes(spark: SparkSession) -> DataFrame:
    return _literal_rows(spark, [(*row, i) for i, row in enumerate(PLACES)], POSTCODE_SCHEMA)


def sample_addresses(spark: SparkSession) -> DataFrame:
    """Every sample street in every sample place, five numbers each, some with a letter."""
    places = _literal_rows(
        spark, [(s, plz, ort) for plz, ort, _, _ in PLACES for s in STREETS], "str_name string, plz int, ort string"
    )
    numbered = places.withColumn("hausnr", F.explode(F.sequence(F.lit(1), F.lit(5))))
    letter = F.when(F.col("hausnr") == 5, F.lit("a")).when(F.col("hausnr") == 4, F.lit(""))
    return numbered.select("str_name", "hausnr", letter.alias("hausnr_zus"), "plz", "ort")


def drop_rest(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.lower(F.col(name)) != REST_NAME)


def female_code(gender: Column) -> Column:
    """The statistic writes W for women, everything here F."""
    return F.when(gender == "W", F.lit("F")).otherwise(gender)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup from parquet, or from a `;` separated CSV file with a header."""
    if ".csv" in path.lower():
        return spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
    return spark.read.parquet(path)


def _clean(raw: DataFrame, schema: str, path: str) -> DataFrame:
    """The wanted columns in their types. In a name statistic the entry for all other names goes, equal rows become one,
    and a statistic with a row for each bearer is counted."""
    wanted = dict(part.strip().split(" ", 1) for part in schema.split(","))
    have = {c.lower(): c for c in raw.columns}
    weight = "anzahl" if "anzahl" in wanted else None
    if absent := [c for c in wanted if c not in have and c != weight]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    df = raw.select(*[F.col(f"`{have[c]}`").try_cast(kind).alias(c) for c, kind in wanted.items() if c in have])
    if weight is None:
        return df
    names = [c for c in wanted if c != weight]
    df = drop_rest(df, names[0]).where(F.col(names[0]) != "")
    count = F.sum(weight) if weight in have else F.count("*")
    return df.groupBy(*names).agg(count.cast(wanted[weight]).alias(weight)).where(F.col(weight) > 0)


def lookup_table(spark: SparkSession, folder: str, name: str, schema: str, cache: str | None = None) -> DataFrame | None:
    """A lookup of a folder: `name.parquet` if it is there, else `name.csv`, cleaned and kept as parquet in `cache`
    (the folder `cache` beside the file by default); None if there is neither.

    A changed CSV file makes a new version. Names are summed up whether the file has weights or a row for each bearer.
    """
    root = folder.rstrip("/")
    if is_there(spark, f"{root}/{name}.parquet"):
        return _clean(spark.read.parquet(f"{root}/{name}.parquet"), schema, f"{root}/{name}.parquet")
    path = f"{root}/{name}.csv"
    files = files_at(spark, path)
    if files is None:
        return None
    return cached(spark, cache or f"{root}/cache", name, fingerprint(files, schema), lambda: _clean(read_csv(spark, path, keep_missing_texts=True), schema, path))


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """The tab separated postcode list; `ord` keeps the order of its lines."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.select(
        F.col("plz_postleitzahl").try_cast("int").alias("plz_postleitzahl"),
        "gemeinde_name",
        "kanton_name",
        "kanton_name_kurz",
        F.monotonically_increasing_id().alias("ord"),
    )


def library_last_name(dg: Column, index: int = 0) -> Column:
    return one_of(LAST_NAMES, dg, index)


def library_first_name(dg: Column, female: Column, index: int = 0) -> Column:
    return F.when(female, one_of(FEMALE_NAMES, dg, index)).otherwise(one_of(MALE_NAMES, dg, index))


def library_any_first_name(dg: Column, index: int = 0) -> Column:
    return one_of(FEMALE_NAMES + MALE_NAMES, dg, index)


def library_street(dg: Column, index: int = 0) -> Column:
    return one_of(STREETS, dg, index)


def library_street_address(dg: Column) -> Column:
    return F.concat(library_street(dg, 2), F.lit(" "), (below(dg, 100, 3) + 1).cast("string"))


def library_email(dg: Column) -> Column:
    """`first.last` and three digits at a reserved domain."""
    return F.concat(
        F.lower(library_any_first_name(dg, 1)),
        F.lit("."),
        F.lower(one_of([n for n in LAST_NAMES if n.isascii() and n.isalpha()], dg, 2)),
        F.lpad(below(dg, 1000, 3).cast("string"), 3, "0"),
        F.lit("@example.org"),
    )


@dataclass
class Lookups:
    """The lookup tables of one run; prepared picks are built once and reused by every column.

    Prepared lookups up to `broadcast_bytes` (64 MiB by default) are broadcast, larger ones joined by salted shuffle.
    """

    spark: SparkSession
    first_names: DataFrame | None = None
    last_names: DataFrame | None = None
    addresses: DataFrame | None = None
    postcodes: DataFrame | None = None
    broadcast_bytes: int | None = None
    _slots: dict[str, Slots] = field(default_factory=dict, repr=False)

    @classmethod
    def from_files(cls, spark: SparkSession, folder: str, cache: str | None = None) -> "Lookups":
        """`first_names`, `last_names` and `addresses`, each as parquet or CSV, and `postcodes.csv`, tab separated.

        Any of them may be absent; the sample takes its place. CSV files are kept as parquet in `cache`.
        """
        root = folder.rstrip("/")
        return cls(
            spark,
            lookup_table(spark, root, "first_names", FIRST_NAME_SCHEMA, cache),
            lookup_table(spark, root, "last_names", LAST_NAME_SCHEMA, cache),
            lookup_table(spark, root, "addresses", ADDRESS_SCHEMA, cache),
            read_postcodes(spark, f"{root}/postcodes.csv") if is_there(spark, f"{root}/postcodes.csv") else None,
        )

    @cached_property
    def first(self) -> DataFrame:
        raw = self.first_names if self.first_names is not None else sample_first_names(self.spark)
        return drop_rest(raw, "vorname").select(
            "vorname", female_code(F.col("geschlecht")).alias("geschlecht"), F.col("anzahl").cast("bigint").alias("anzahl")
        )

    @cached_property
    def last(self) -> DataFrame:
        raw = self.last_names if self.last_names is not None else sample_last_names(self.spark)
        return drop_rest(raw, "nachname").select("nachname", F.col("anzahl").cast("bigint").alias("anzahl"))

    @cached_property
    def address(self) -> DataFrame:
        raw = self.addresses if self.addresses is not None else sample_addresses(self.spark)
        return raw.select("str_name", "hausnr", "hausnr_zus", "plz", "ort")

    @cached_property
    def postcode(self) -> DataFrame:
        return self.postcodes if self.postcodes is not None else sample_postcodes(self.spark)

    @cached_property
    def streets(self) -> DataFrame:
        return self.address.select("str_name", "ort", "plz").distinct()

    @cached_property
    def gender_of_name(self) -> DataFrame:
        """One row per first name: the gender that bears it most often."""
        per = self.first.groupBy("vorname", "geschlecht").agg(F.sum("anzahl").alias("n"))
        return per.groupBy("vorname").agg(
            F.max(F.struct("n", "geschlecht"))["geschlecht"].alias("geschlecht")
        )

    def slots(self, name: str, rows: DataFrame, values: list[str], group: Column | None = None, weight: Column | None = None) -> Slots:
        if name not in self._slots:
            self._slots[name] = build_slots(rows, values, group, weight, broadcast_bytes=self.broadcast_bytes)
        return self._slots[name]

    def last_name_slots(self) -> Slots:
        return self.slots("last", self.last, ["nachname"], weight=F.col("anzahl"))

    def first_name_slots(self) -> Slots:
        gender = F.when(F.col("geschlecht") == "M", F.lit("M")).otherwise(F.lit("F"))
        return self.slots("first", self.first, ["vorname"], gender, F.col("anzahl"))

    def address_slots(self, area: str | None, extra: str | None = None) -> Slots:
        """Addresses, all or per area column (`plz`, `ort`) or per area and street."""
        values = ["str_name", "hausnr", "hausnr_zus", "plz", "ort"]
        group = None
        if area:
            group = F.col(area).cast("string")
        if extra:
            group = F.concat_ws("|", F.col(extra), group) if group is not None else F.col(extra)
        return self.slots(f"address/{area}/{extra}", self.address, values, group)

    def street_slots(self, area: str | None) -> Slots:
        group = F.col(area).cast("string") if area else None
        return self.slots(f"street/{area}", self.streets, ["str_name", "ort", "plz"], group)

    def postcode_slots(self, group: str | None) -> Slots:
        values = ["plz_postleitzahl", "gemeinde_name", "kanton_name", "kanton_name_kurz"]
        column = F.col(group) if group else None
        return self.slots(f"postcode/{group}", self.postcode, values, column)
