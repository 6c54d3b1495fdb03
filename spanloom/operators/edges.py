"""Import and call edges from fact tables, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def import_edges(facts: DataFrame) -> DataFrame:
    """(importer, imported, lines): first-party imports; ``from pkg import sub`` names the submodule where there is one."""
    modules = facts.where("fact = 'span' and kind = 'module'").select(F.col("module").alias("m")).distinct()
    bound = facts.where("fact = 'binding' and kind != 'root'").withColumn("full", F.when(F.col("kind") == "symbol", F.concat_ws(".", "receiver", "target")).otherwise(F.col("target")))
    tiers = bound.select("module", "start_line", "full", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("full").alias("m")), F.struct(F.lit(1).alias("tier"), F.col("receiver").alias("m")))).alias("x")).select("module", "start_line", "full", "x.*")
    found = tiers.join(modules, "m").withColumn("best", F.min("tier").over(Window.partitionBy("module", "start_line", "full"))).where("tier = best")
    return found.where("module != m").groupBy(F.col("module").alias("importer"), F.col("m").alias("imported")).agg(F.sort_array(F.collect_set("start_line")).alias("lines"))


def call_edges(facts: DataFrame) -> DataFrame:
    """(caller, caller_kind, caller_module, callee, callee_kind, callee_module, resolution, lines).

    A name is a top-level definition of the same module, else of the module that it is imported from. ``self.name`` in a method
    is a method of its class. Another dotted receiver is the longest prefix that is bound to a module, which has to define
    the last name at its top: methods are not reached this way. Callers are modules, functions and methods.
    """
    defined = facts.where("fact = 'span' and kind in ('class', 'function') and get_json_object(data, '$.top') = 'true'")
    defined = defined.groupBy(F.col("module").alias("callee_module"), F.col("fq").alias("callee"), F.col("name").alias("defined")).agg(F.max("kind").alias("callee_kind"))
    methods = facts.where("fact = 'span' and kind = 'method'").select(F.col("module").alias("callee_module"), F.col("fq").alias("callee"), F.col("name").alias("defined"), F.lit("method").alias("callee_kind"), F.col("receiver").alias("of")).distinct()
    own = facts.where("fact = 'call' and target is not null").select("module", F.col("kind").alias("caller_kind"), F.col("fq").alias("caller"), "name", "target", "receiver", "start_line")
    # The last binding of a name in a file wins.
    last = Window.partitionBy("module", "kind", "name").orderBy(F.desc("start_line"), F.desc("fq"), F.desc("target"))
    bound = facts.where("fact = 'binding'").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    symbols = bound.where("kind = 'symbol'").select("module", "name", F.col("receiver").alias("from_module"), F.col("target").alias("symbol"))
    known = facts.where("fact = 'span' and kind = 'module'").select(F.col("module").alias("sub")).distinct()
    # ``from pkg import sub`` binds a module too.
    subs = symbols.withColumn("sub", F.concat_ws(".", "from_module", "symbol")).join(known, "sub", "left_semi").select("module", "name", F.col("sub").alias("bound_module"))
    modules = bound.where("kind in ('module', 'root')").select("module", "name", F.col("target").alias("bound_module")).unionByName(subs)
    modules = modules.groupBy("module", "name").agg(F.max("bound_module").alias("bound_module"))

    plain = own.where("receiver is null")
    local = plain.join(defined, (F.col("module") == F.col("callee_module")) & (F.col("name") == F.col("defined"))).withColumn("tier", F.lit(0)).withColumn("resolution", F.lit("same_module"))
    imported = plain.join(symbols, ["module", "name"]).join(defined, (F.col("from_module") == F.col("callee_module")) & (F.col("symbol") == F.col("defined"))).withColumn("tier", F.lit(1)).withColumn("resolution", F.lit("imported"))
    on_self = own.where("receiver = 'self' and caller_kind = 'method'").withColumn("class", F.regexp_replace("caller", r"\.[^.]*$", ""))
    on_self = on_self.join(methods, (F.col("class") == F.col("of")) & (F.col("name") == F.col("defined"))).withColumn("tier", F.lit(0)).withColumn("resolution", F.lit("self"))
    parts = F.split("receiver", "[.]")
    through = own.where("receiver is not null and not (receiver = 'self' and caller_kind = 'method')").withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, 1, F.col("k")), "."))
    met = through.join(modules.withColumnRenamed("name", "prefix"), ["module", "prefix"])
    longest = met.withColumn("rn", F.row_number().over(Window.partitionBy("caller", "target", "start_line").orderBy(F.desc("k")))).where("rn = 1")
    longest = longest.withColumn("candidate", F.concat_ws(".", F.array("bound_module"), F.slice(parts, F.col("k") + 1, F.size(parts))))
    through = longest.join(defined, (F.col("candidate") == F.col("callee_module")) & (F.col("name") == F.col("defined"))).withColumn("tier", F.lit(0)).withColumn("resolution", F.lit("imported"))

    columns = ["module", "caller_kind", "caller", "target", "start_line", "callee_module", "callee", "callee_kind", "tier", "resolution"]
    every = local.select(*columns).unionByName(imported.select(*columns)).unionByName(on_self.select(*columns)).unionByName(through.select(*columns))
    best = every.withColumn("best", F.min("tier").over(Window.partitionBy("caller", "target", "start_line"))).where("tier = best")
    return best.groupBy("caller", "caller_kind", F.col("module").alias("caller_module"), "callee", "callee_kind", "callee_module").agg(F.min("resolution").alias("resolution"), F.sort_array(F.collect_set("start_line")).alias("lines"))
