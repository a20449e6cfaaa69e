"""Overlay geometry that columns can't express, by the JTS library among Spark's own jars.

Opt-in: the one class is compiled on first use with the Janino compiler, which
Spark ships for its own code generation, and added to the running session, which
hands it to the executors.  No JDK is needed.  Results needn't equal those of
other overlay libraries to the last digit.
"""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cityloom.session import shared_dir
from cityloom.sources.files import committed_output

NAME, CLASS = "cityloom_geometry", "cityloom.jts.GeometryFunction"
_ready: set[str] = set()


def _compiled(spark: SparkSession) -> bytes:
    """The class as a jar."""
    jvm = spark._jvm
    with open(os.path.join(os.path.dirname(__file__), "GeometryFunction.java"), encoding="utf-8") as f:
        source = f.read()
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    codes = compiler.getBytecodes()
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for name in codes:
            z.writestr(str(name).replace(".", "/") + ".class", bytes(codes[name]))
    return jar.getvalue()


def register(spark: SparkSession) -> None:
    """Compile, ship and register the function once per session."""
    session = spark.sparkContext.applicationId + spark._jsparkSession.sessionUUID()
    if session in _ready:
        return
    jar = shared_dir(spark, "jts") + "/cityloom-jts.jar"
    with committed_output(jar) as out:
        out.write(_compiled(spark))
    spark.sql(f"ADD JAR '{jar}'")
    loader = spark._jsparkSession.artifactManager().classloader()
    function = loader.loadClass(CLASS).getDeclaredConstructor(None).newInstance(None)
    spark._jsparkSession.udf().register(NAME, function, spark._jvm.org.apache.spark.sql.types.DataTypes.StringType)
    _ready.add(session)


def overlay(op: str, a: Column, b: Column | None = None, d: float = 0.0) -> Column:
    """Well-known text of an operation: fix, polygonal, union, intersection, difference, shared, round, mitre, close, open, simplify, fill, drop, largest, interior, pole, rectangle, hull, triangulate."""
    return F.call_function(NAME, F.lit(op), a, F.lit(None).cast("string") if b is None else b, F.lit(float(d)))


def failure(op: str, a: Column, b: Column | None = None, d: float = 0.0) -> Column:
    """Why an operation gives null though its input isn't: the message of what it threw; else null."""
    return overlay("error:" + op, a, b, d)


def measure(op: str, a: Column, b: Column | None = None) -> Column:
    """area, length, parts, distance, or the area of an intersection (shared area) or a difference (rest area) as a number."""
    return overlay(op, a, b).cast("double")


def holds(op: str, a: Column, b: Column) -> Column:
    """covers, intersects or touches as a truth value."""
    return overlay(op, a, b) == "true"


def polygon_text(ring: Column) -> Column:
    """Well-known text of a closed ring."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def collection_text(texts: Column) -> Column:
    return F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(texts, ", "), F.lit(")"))
