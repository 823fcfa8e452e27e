"""Fixed schemas of the tables that steps exchange."""

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "double": DoubleType(), "long": LongType(), "strings": ArrayType(StringType())}


def _struct(**columns: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in columns.items()])


_PAIR = {"feature_1": "string", "feature_2": "string", "method": "string"}
_INTERVAL = lambda name: {f"{x}_{name}": "double" for x in ("z", "se", "r")} | {f"ci_r_{name}_{x}": "double" for x in ("low", "high")}

OBSERVATIONS = _struct(study_id="string", sample_id="string", feature="string", value="double")
RAW_OBSERVATIONS = _struct(study_id="string", sample_id="string", feature="string", raw="string")
CORRELATIONS = _struct(**_PAIR, corr="double", p_value="double", n="double", study_id="string")
POOLED = _struct(**_PAIR, n_studies="long", **_INTERVAL("fixed"), Q="double", df="long", I2="double", tau2="double", **_INTERVAL("random"))
EDGES = _struct(source="string", target="string", **dict.fromkeys(("weight", "distance", "distance_signed", "r", "ci_low", "ci_high"), "double"))
SETS = _struct(set_id="string", set_name="string", members="strings")
