"""Collections of documents on shared storage: append, replace, delete, update, look up; and a guard for SQL texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import stash

COLUMNS = "id string, text string, metadata map<string,string>, embedding array<float>"


class Collection:
    """Folders of Parquet files and numbered versions, each a list of folders.

    Rows are written first and then named by a version, so a reader sees the old or the new one. Of two writers the later one finds
    its number taken and works on the other's version; appending writes the new rows only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _latest(self) -> tuple[int, list[str]]:
        """The number of the last version (-1 without any) and its folders."""
        folder = self._path("_versions")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        names = [n for n in names if n.isdigit()]
        if not names:
            return -1, []
        lines = self.spark.read.text(f"{self.path}/_versions/{names[-1]}").collect()  # a line for each folder
        return int(names[-1]), [r["value"] for r in lines]

    def exists(self) -> bool:
        return self._latest()[0] >= 0

    def read(self) -> DataFrame:
        _, folders = self._latest()
        if not folders:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders))

    def _write(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _publish(self, number: int, folders: list[str]) -> bool:
        """Name version `number`; False if another writer has named it."""
        staged, final = self._path(f"_staged-{uuid.uuid4().hex}"), self._path("_versions", f"{number:012d}")
        out = self._fs.create(staged)
        out.write(bytearray("\n".join(folders), "utf-8"))
        out.close()
        self._fs.mkdirs(final.getParent())
        files = self._jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, final, self.spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _replace(self, change: Callable[[DataFrame], DataFrame]) -> None:
        while True:
            number, _ = self._latest()
            if self._publish(number + 1, [self._write(change(self.read()))]):
                return

    def overwrite(self, docs: DataFrame) -> None:
        self._replace(lambda _: docs)

    def append(self, docs: DataFrame) -> None:
        added = self._write(docs)
        while True:
            number, folders = self._latest()
            if self._publish(number + 1, [*folders, added]):
                return

    def delete(self, ids: DataFrame) -> None:
        """Without the rows whose id is in the first column of ids."""
        self._replace(lambda old: old.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_anti").select(*old.columns))

    def update(self, changes: DataFrame) -> None:
        """New text or metadata of known ids; nulls keep the old value, unknown ids are ignored."""
        new = changes.select("id", F.col("text").alias("__t"), F.col("metadata").alias("__m"))
        self._replace(lambda old: old.join(new, "id", "left").withColumn("text", F.coalesce("__t", "text")).withColumn("metadata", F.coalesce("__m", "metadata")).select(*old.columns))

    def info(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("documents"), F.count("embedding").alias("embedded"))


TREES = "org.apache.spark.sql.catalyst.trees.TreeNode"
PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
#: What a query may be made of, as the parser names it; whatever is not here is refused.
PLANS = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort Distinct Union Intersect Except GlobalLimit LocalLimit Offset SubqueryAlias OneRowRelation LocalRelation Generate Sample Pivot Unpivot Window "
    "WithWindowDefinition UnresolvedWith UnresolvedRelation UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer range stack".split())
FUNCTIONS = TABLE_FUNCTIONS | frozenset(
    # aggregates and windows
    "any_value approx_count_distinct avg bool_and bool_or collect_list collect_set corr count count_if covar_pop covar_samp every first first_value kurtosis last last_value listagg max max_by mean median min min_by mode "
    "percentile percentile_approx percentile_cont percentile_disc some skewness std stddev stddev_pop stddev_samp sum string_agg try_avg try_sum var_pop var_samp variance cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number grouping grouping_id "
    # conditions, casts and numbers
    "between coalesce if ifnull nullif nullifzero nvl nvl2 zeroifnull isnan isnull isnotnull abs ceil ceiling exp floor greatest least ln log log10 log2 mod negative pmod power pow rand round bround sign sqrt width_bucket bigint boolean date decimal double float int smallint string timestamp tinyint "
    # texts
    "ascii char_length character_length concat concat_ws contains endswith initcap instr lcase left length levenshtein like locate lower lpad ltrim md5 overlay position regexp regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right rlike rpad rtrim sha2 split split_part startswith substr substring substring_index translate trim ucase upper "
    # times
    "add_months current_date current_timestamp date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract from_unixtime hour last_day make_date minute month months_between next_day now quarter second timestampadd timestampdiff to_date to_timestamp trunc unix_timestamp weekofyear window year "
    # arrays, maps, structs and JSON
    "array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_size array_sort array_union arrays_zip aggregate cardinality element_at exists filter flatten forall from_json get get_json_object json_array_length map map_from_arrays map_keys map_values named_struct reduce sequence size slice sort_array struct to_json transform zip_with".split()
)


def _parts(value, gateway) -> Iterator:
    """The tree nodes directly below a node or within its lists, options and pairs."""
    if not isinstance(value, JavaObject):
        return
    if is_instance_of(gateway, value, TREES):
        yield value
    elif is_instance_of(gateway, value, "scala.collection.Iterable"):
        rows = value.iterator()
        while rows.hasNext():
            yield from _parts(rows.next(), gateway)
    elif is_instance_of(gateway, value, "scala.Option"):
        if value.isDefined():
            yield from _parts(value.get(), gateway)
    elif is_instance_of(gateway, value, "scala.Product"):
        for k in range(value.productArity()):
            yield from _parts(value.productElement(k), gateway)


def _tables(node, gateway, known: frozenset[str]) -> Iterator[str]:
    """Names of the tables that a parsed query reads, those of common table expressions in scope left out.

    Raises ValueError where the tree holds a plan or a function that is not listed, or a name that is made while the query runs.
    """
    kind = node.getClass().getSimpleName()
    if kind.endswith("UnresolvedIdentifier"):
        raise ValueError("names are to be written out, not computed")
    if is_instance_of(gateway, node, PLAN) and kind not in PLANS:
        raise ValueError(f"{kind} is not allowed in a query")
    if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
        parts = (node.nameParts() if kind == "UnresolvedFunction" else node.name()).mkString("\0").lower().split("\0")
        if len(parts) > 1 or parts[0] not in (FUNCTIONS if kind == "UnresolvedFunction" else TABLE_FUNCTIONS):
            raise ValueError(f"function {'.'.join(parts)} is not allowed in a query")
    if kind == "UnresolvedGenerator" and node.name().unquotedString().lower() not in TABLE_FUNCTIONS:
        raise ValueError(f"function {node.name().unquotedString()} is not allowed in a query")
    if kind == "UnresolvedRelation":
        name = ".".join(n.lower() for n in node.multipartIdentifier().mkString("\0").split("\0"))
        if name not in known:
            yield name
    if kind == "UnresolvedWith":
        definitions = node.cteRelations().iterator()
        while definitions.hasNext():
            named = definitions.next()
            yield from _tables(named.productElement(1), gateway, known)
            known = known | {named.productElement(0).lower()}
        yield from _tables(node.child(), gateway, known)
        return
    for k in range(node.productArity()):
        for below in _parts(node.productElement(k), gateway):
            yield from _tables(below, gateway, known)


def safe_select(spark: SparkSession, query: str, tables: set[str] | None = None) -> DataFrame:
    """Run one SELECT or WITH; its whole parsed tree decides, not words in its text.

    Raises ValueError for any plan beyond PLANS and any function beyond FUNCTIONS anywhere in it, so for commands, writes, dynamic
    statements and names, and calls into the JVM; and, where tables are given, for any other table that it reads. The name of a
    common table expression counts only where it is in scope. Without `tables` every table and file that Spark can read is open.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as e:
        raise ValueError(f"not one statement of SQL: {e}") from e
    used = set(_tables(plan, spark.sparkContext._gateway, frozenset()))
    if tables is not None and (unknown := used - {t.lower() for t in tables}):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return spark.sql(query)


def sequential_ids(docs: DataFrame, prefix: str, start: int = 0) -> DataFrame:
    """docs with ids prefix_n in row order, by the rows of the partitions before; no global sort.

    The rows are written once, so that counting and numbering see the same ones whatever docs is made of.
    """
    rows = stash(docs.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    offsets = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start).alias("__first"))
    # the id's lower 33 bits number the rows within their partition
    n = F.col("__first") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "__p").withColumn("id", F.concat(F.lit(prefix + "_"), n.cast("string"))).drop("__p", "__i", "__first")
