"""Declared table schemas (nothing is inferred at read time)."""

from pyspark.sql import types as T


def _struct(spec):
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "string": T.StringType(), "strings": T.ArrayType(T.StringType()),
        "doubles": T.ArrayType(T.DoubleType()),
    }
    fields = [part.split(":") for part in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


RAW_UTTERANCES = _struct(
    "idx:long dialogue_id:string role:int turn:int sentence:string er_label_1:string "
    "ee_label_1:string er_label_2:string ee_label_2:string neg:double neu:double pos:double")

MERGED_TURNS = _struct(
    "idx:long dialogue_id:string role:int turn:int sentence:string er_label_1:strings "
    "ee_label_1:strings er_label_2:strings ee_label_2:strings neg:doubles neu:doubles pos:doubles")

TURNS = _struct(
    "idx:long dialogue_id:string role:int turn:int sentence:string eml_label:int pr_label:string "
    "pr_confidence:double da_label:string multi_da_labels:strings")

# one 0/1 column per rater, and the joint rating
RATED_UTTERANCES = _struct(
    "seq:long speaker:string conversation_id:string text:string manipulation_1:int manipulation_2:int "
    "manipulation_3:int manipulation_4:int manipulation:int")

# three raters' flags and outcome codes (1, 0, -1)
MANUAL_SAMPLE = _struct(
    "index:long dialogue_id:string role:int turn:int sentence:string manipulation_1:int "
    "manipulation_2:int manipulation_3:int persuasion_result_1:int persuasion_result_2:int "
    "persuasion_result_3:int da_label:string")

# one row per table of a report bundle
MANIFEST = _struct("version:long run:string name:string format:string path:string")


def all_string(schema):
    """The same columns, every one read as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
