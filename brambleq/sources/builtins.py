"""A small table of the language's own symbols.  It is not complete: findings that
say a function does not exist are made only when a caller says the table is."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Class-like symbols (kind, name, parents in order).
CLASSES = [
    ("interface", "Traversable", ()), ("interface", "Iterator", ("Traversable",)), ("interface", "IteratorAggregate", ("Traversable",)), ("interface", "ArrayAccess", ()), ("interface", "Countable", ()), ("interface", "Serializable", ()), ("interface", "JsonSerializable", ()), ("interface", "Stringable", ()), ("interface", "UnitEnum", ()), ("interface", "BackedEnum", ("UnitEnum",)),
    ("interface", "Throwable", ("Stringable",)), ("class", "Exception", ("Throwable",)), ("class", "Error", ("Throwable",)), ("class", "ErrorException", ("Exception",)), ("class", "TypeError", ("Error",)), ("class", "ValueError", ("Error",)), ("class", "ArithmeticError", ("Error",)), ("class", "DivisionByZeroError", ("ArithmeticError",)), ("class", "ArgumentCountError", ("TypeError",)), ("class", "AssertionError", ("Error",)), ("class", "UnhandledMatchError", ("Error",)), ("class", "JsonException", ("Exception",)),
    ("class", "LogicException", ("Exception",)), ("class", "BadFunctionCallException", ("LogicException",)), ("class", "BadMethodCallException", ("BadFunctionCallException",)), ("class", "DomainException", ("LogicException",)), ("class", "InvalidArgumentException", ("LogicException",)), ("class", "LengthException", ("LogicException",)), ("class", "OutOfRangeException", ("LogicException",)), ("class", "RuntimeException", ("Exception",)), ("class", "OutOfBoundsException", ("RuntimeException",)), ("class", "OverflowException", ("RuntimeException",)), ("class", "RangeException", ("RuntimeException",)), ("class", "UnderflowException", ("RuntimeException",)), ("class", "UnexpectedValueException", ("RuntimeException",)),
    ("class", "stdClass", ()), ("class", "Closure", ()), ("class", "Generator", ("Iterator",)), ("class", "ArrayObject", ("IteratorAggregate", "ArrayAccess", "Countable")), ("class", "ArrayIterator", ("Iterator", "ArrayAccess", "Countable")), ("class", "SplObjectStorage", ("Countable", "Iterator", "ArrayAccess")), ("class", "WeakMap", ("ArrayAccess", "Countable", "IteratorAggregate")), ("class", "WeakReference", ()), ("interface", "DateTimeInterface", ()), ("class", "DateTime", ("DateTimeInterface",)), ("class", "DateTimeImmutable", ("DateTimeInterface",)), ("class", "DateInterval", ()), ("class", "DateTimeZone", ()), ("class", "Attribute", ()), ("class", "Override", ()), ("class", "AllowDynamicProperties", ()), ("class", "ReturnTypeWillChange", ()), ("class", "SensitiveParameter", ()), ("class", "PDO", ()), ("class", "ReflectionClass", ()),
]
#: Names of functions.
FUNCTIONS = (
    "strlen count sizeof printf sprintf fprintf vsprintf implode explode join in_array array_map array_filter array_merge array_keys array_values array_key_exists array_search array_slice array_splice array_push array_pop array_shift array_unshift array_reverse array_unique array_combine array_fill array_flip array_sum array_diff array_intersect range min max abs floor ceil round intdiv is_array is_string is_int is_null is_bool is_float is_numeric is_callable is_object is_iterable "
    "trim ltrim rtrim strtolower strtoupper ucfirst lcfirst str_replace str_repeat str_pad str_contains str_starts_with str_ends_with substr strpos strrpos strrev strcmp preg_match preg_match_all preg_replace preg_split preg_quote json_encode json_decode define defined constant function_exists class_exists method_exists property_exists get_class gettype settype var_dump var_export print_r serialize unserialize file_get_contents file_put_contents fopen fclose fread fwrite file_exists is_file dirname basename date time mktime strtotime microtime usleep sleep rand mt_rand random_int usort uasort uksort sort rsort ksort krsort call_user_func call_user_func_array func_get_args compact extract iterator_to_array spl_object_id htmlspecialchars md5 sha1 hash number_format exit trigger_error error_log set_error_handler"
).split()
CONSTANTS = "PHP_EOL PHP_VERSION PHP_INT_MAX PHP_INT_MIN PHP_INT_SIZE PHP_FLOAT_EPSILON PHP_OS DIRECTORY_SEPARATOR E_ALL E_ERROR E_WARNING E_NOTICE E_STRICT M_PI NAN INF SORT_STRING JSON_THROW_ON_ERROR JSON_PRETTY_PRINT STDIN STDOUT STDERR".split()


def manifest(php: int) -> str:
    """The manifest that serves a target version."""
    return "8.4" if php < 80500 else "8.5" if php < 80600 else "8.6"


def declarations(spark: SparkSession) -> DataFrame:
    """(``kind``, ``key``, ``fqn``, ``what``, ``parents``) of the table above."""
    rows = [("class", n.lower(), n, k, list(p)) for k, n, p in CLASSES] + [("function", n, n, None, []) for n in FUNCTIONS] + [("constant", n, n, None, []) for n in CONSTANTS]
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
    # from Arrow, the rows are a local relation of the plan and need no worker
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "key", "fqn", "what", "parents"), columns, kinds, strict=True)}))
