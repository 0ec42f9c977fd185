"""Fixed values of the analysis: patterns, word lists, weights and labels.

They define what is recognised and how it counts, so they are plain data here.
(?U) gives \\w, \\b and \\s their Unicode meaning.
"""

from __future__ import annotations

# --- Java structure ----------------------------------------------------------

#: Comments, text blocks, strings and characters; unterminated ones reach the end.
LITERALS = (
    r"//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r'|"""[\s\S]*?(?:"""|\z)'
    r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\\?+"?+'
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+\\?+'?+"
)
#: Words that a method's name can't be.
KEYWORDS = (
    "if", "for", "while", "switch", "catch", "synchronized", "return", "new",
    "else", "do", "try", "finally", "assert", "throw",
)
#: Java's modifiers.
MODIFIERS = (
    "public", "private", "protected", "static", "final", "abstract",
    "synchronized", "native", "default", "strictfp", "transient", "volatile",
)

# --- operations: (label, pattern, priority) ----------------------------------

#: Calls that only the Spark API has.
STRONG = (
    ("JOB_START", r"\bSparkSession\s*\.\s*builder\s*\(|\bnew\s+JavaSparkContext\b|\bnew\s+SparkContext\b", "HIGH"),
    ("DATASET_READ", r"\bspark\s*\.\s*read\s*\(\s*\)|\b\w*[sS]park\w*\s*\.\s*read\s*\(\s*\)|\bspark\s*\.\s*table\s*\(|\bDataFrameReader\b", "HIGH"),
    ("DATASET_WRITE", r"\b\w+\s*\.\s*write\s*\(\s*\)|\bDataFrameWriter\b|\.\s*saveAsTable\s*\(", "HIGH"),
    ("JOIN", r"\.\s*join\s*\(|\.\s*crossJoin\s*\(", "HIGH"),
    ("FILTER", r"\.\s*where\s*\(", "HIGH"),
    ("GROUP_BY", r"\.\s*groupBy\s*\(|\.\s*groupByKey\s*\(|\.\s*rollup\s*\(|\.\s*cube\s*\(", "HIGH"),
    ("AGGREGATION", r"\.\s*agg\s*\(|\.\s*reduceByKey\s*\(", "HIGH"),
    ("DEDUPLICATION", r"\.\s*dropDuplicates\s*\(", "HIGH"),
    ("REPARTITION", r"\.\s*repartition\s*\(|\.\s*coalesce\s*\(", "MEDIUM"),
    ("SORT", r"\.\s*orderBy\s*\(", "MEDIUM"),
    ("UNION", r"\.\s*unionByName\s*\(", "MEDIUM"),
    ("MAP", r"\.\s*mapPartitions\s*\(", "MEDIUM"),
    ("WITH_COLUMN", r"\.\s*withColumn\s*\(|\.\s*withColumnRenamed\s*\(", "LOW"),
    ("SELECT", r"\.\s*selectExpr\s*\(", "LOW"),
    ("SPARK_ACTION", r"\.\s*saveAsTextFile\s*\(", "MEDIUM"),
)
#: Calls that the JDK has as well; they count only where Spark is in sight.
AMBIGUOUS = (
    ("FILTER", r"\.\s*filter\s*\(", "HIGH"),
    ("AGGREGATION", r"\.\s*reduce\s*\(", "HIGH"),
    ("DEDUPLICATION", r"\.\s*distinct\s*\(", "HIGH"),
    ("SORT", r"\.\s*sort\s*\(", "MEDIUM"),
    ("UNION", r"\.\s*union\s*\(", "MEDIUM"),
    ("MAP", r"\.\s*map\s*\(|\.\s*flatMap\s*\(", "MEDIUM"),
    ("SELECT", r"\.\s*select\s*\(|\.\s*drop\s*\(", "LOW"),
    ("DATASET_WRITE", r"\.\s*save\s*\(\s*\)", "HIGH"),
    ("SPARK_ACTION", r"\.\s*(?:count|collect|first|take|show|foreach)\s*\(", "MEDIUM"),
)
#: Formats, looked for in the raw text because literals matter.
FORMATS = (
    ("PARQUET_WRITE", r"\.\s*write\b[\s\S]{0,200}?\.\s*parquet\s*\(|\.\s*write\b[\s\S]{0,120}?format\s*\(\s*\"parquet\"\s*\)", "HIGH"),
    ("PARQUET_READ", r"\.\s*read\s*\(\s*\)[\s\S]{0,200}?\.\s*parquet\s*\(|\.\s*read\s*\(\s*\)[\s\S]{0,120}?format\s*\(\s*\"parquet\"\s*\)", "HIGH"),
)
#: The general label that a format's label replaces on the same line.
REPLACES = {"DATASET_READ": "PARQUET_READ", "DATASET_WRITE": "PARQUET_WRITE"}

SPARK_TYPES = (
    r"\b(Dataset|DataFrame|SparkSession|JavaSparkContext|SparkContext|JavaRDD|"
    r"JavaPairRDD|RelationalGroupedDataset|KeyValueGroupedDataset)\b"
    r"|\bfunctions\s*\.|\borg\.apache\.spark\b"
)
#: Receivers before an ambiguous call that speak against Spark.
OTHER_RECEIVERS = (
    r"(?:\.\s*stream\s*\(\s*\)|\.\s*parallelStream\s*\(\s*\)|Optional[.<]|"
    r"\.\s*entrySet\s*\(\s*\)|\.\s*keySet\s*\(\s*\)|\.\s*values\s*\(\s*\)|"
    r"Stream\s*\.|Collectors\s*\.|Arrays\s*\.|Collections\s*\.|IntStream\b|List\s*\.\s*of)"
    r"[\s\S]{0,60}\z"
)
#: External input and output, by kind; on one line the first pattern that fits counts.
EXTERNAL_IO = (
    ("jdbc", r"\bDriverManager\s*\.\s*getConnection\s*\("),
    ("jdbc", r"\b\w*[dD]ataSource\s*\.\s*getConnection\s*\("),
    ("jdbc", r"\.\s*(?:executeQuery|executeUpdate|executeBatch)\s*\("),
    ("jdbc", r"\b(?:JdbcTemplate|NamedParameterJdbcTemplate|EntityManager)\b\s*\.\s*\w+\s*\("),
    ("http", r"\bHttpClient\s*\.\s*newHttpClient\s*\("),
    ("http", r"\b\w*[hH]ttpClient\s*\.\s*(?:send|sendAsync)\s*\("),
    ("http", r"\b(?:RestTemplate|WebClient|OkHttpClient|CloseableHttpClient)\b"),
    ("http", r"\bHttpClients\s*\.\s*(?:createDefault|custom)\s*\("),
    ("http", r"\bnew\s+(?:[\w.]+\.)?URL\s*\([^;]*?\)\s*\.\s*openConnection\s*\("),
    ("file", r"\bnew\s+(?:[\w.]+\.)?File(?:Input|Output)Stream\s*\("),
    ("file", r"\bnew\s+(?:[\w.]+\.)?File(?:Reader|Writer)\s*\("),
    ("file", r"\bFiles\s*\.\s*(?:newInputStream|newOutputStream|newBufferedReader|"
             r"newBufferedWriter|readAllLines|readAllBytes|readString|write|copy|move|delete)\s*\("),
    ("messaging", r"\bnew\s+Kafka(?:Producer|Consumer)\s*\("),
    ("messaging", r"\b(?:KafkaTemplate|JmsTemplate|RabbitTemplate)\b\s*\.\s*\w+\s*\("),
    ("messaging", r"\.\s*(?:send|publish)\s*\(\s*[^)]*(?:topic|queue|exchange)"),
)

# --- logging and exceptions --------------------------------------------------

LOGGER_CALL = (
    r"\b(?:log|logger|LOG|LOGGER|[a-zA-Z_]*[lL]og(?:ger)?)\s*\.\s*"
    r"(info|warn|warning|error|debug|trace|fatal|severe|fine|finer|finest)\s*\("
)
#: A logger's verbs and their levels.
LEVELS = {
    "info": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR",
    "fatal": "ERROR", "severe": "ERROR", "debug": "DEBUG", "fine": "DEBUG",
    "finer": "DEBUG", "finest": "TRACE", "trace": "TRACE",
}
STRING = r'"(?:[^"\\]++|\\.)*+"'
LONG_STRING = r'"(?=(?:[^"\\]|\\.){78})(?:[^"\\]++|\\.)*+"'
KEY_VALUE = r'\w+\s*=\s*(\{\}|"|\+)'
STRUCTURED_ARGS = r"\b\w+Id\b|\brunId\b|\bkv\(|\bStructuredArguments\b"
CATCH = r"\bcatch\s*\(([^)]*)\)\s*\{"
THROW = r"\bthrow\s+new\b|\bthrow\s+\w+\s*;"
ERROR_LOG = r"(?i)\b(?:log|logger|LOG|LOGGER)\s*\.\s*(?:error|warn|fatal|severe)\s*\("
RUN_ID = r"(?i)\b(run[_]?id|correlation[_]?id|trace[_]?id|job[_]?id)\b"

# --- data flow ---------------------------------------------------------------

ACTION = (
    r"\.\s*(?:count|collect|collectAsList|toLocalIterator|isEmpty|first|head)\s*\(\s*\)"
    r"|\.\s*(?:foreach|foreachPartition|take|show|saveAsTextFile|saveAsTable|save)\s*\("
    r"|\.\s*write\s*\(\s*\)"
)
ASSIGNMENT = (
    r"(?s)\A\s*(?:final\s+)?(?:[A-Za-z_$][\w$.]*(?:\s*<[^;=]*?>)?(?:\s*\[\s*\])?\s+)?"
    r"([A-Za-z_$][\w$]*)\s*=\s*(.+)\z"
)
IDENTIFIER = r"[A-Za-z_$][\w$]*"
ACTIONS = ("SPARK_ACTION", "DATASET_WRITE", "PARQUET_WRITE")
READS = ("DATASET_READ", "PARQUET_READ", "EXTERNAL_IO")

# --- secrets and sensitive terms ---------------------------------------------

#: Fixed values: (pattern, replacement), applied in this order.
SECRETS = (
    (r"""(?i)(password|passwd|pwd)\s*[:=]\s*["']?[^"'\s,;)]+""", "$1=***MASKED***"),
    (r"""(?i)(secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret)\s*[:=]\s*["']?[^"'\s,;)]+""", "$1=***MASKED***"),
    (r"""(?i)(token|bearer|authorization)\s*[:=]\s*["']?[^"'\s,;)]+""", "$1=***MASKED***"),
    (r"""(?i)(jdbc:[a-z]+://[^"'\s]*[?&](?:user|password)=)[^"'\s&]+""", "$1***MASKED***"),
    (r"AKIA[0-9A-Z]{16}", "***MASKED_AWS_KEY***"),
    (r'(?i)(key|secret|token)\s*=\s*"[A-Za-z0-9+/]{24,}={0,2}"', '$1="***MASKED***"'),
)
#: Terms that a log should not carry.
SENSITIVE_TERMS = (
    "patient", "patientid", "patient_id", "patientname", "patient_name",
    "mrn", "ssn", "dob", "date_of_birth", "birthdate",
    "diagnosis", "icd", "medication", "prescription", "drug",
    "clinical", "medical_history", "medicalhistory", "notes", "clinical_note",
    "address", "street", "zipcode", "postcode", "phone", "phone_number",
    "email", "e_mail", "firstname", "first_name", "lastname", "last_name",
    "full_name", "fullname", "insurance", "policy_number",
    "password", "passwd", "secret", "token", "api_key", "apikey",
    "credential", "access_token", "private_key",
)
SENSITIVE = r"(?i)\b(" + "|".join(SENSITIVE_TERMS) + r")\b"
WHOLE_OBJECT = r"(?i)\b(request|response|body|payload|patient|record|entity|dto|user)\b\s*[})\]]?\s*\z"
#: What no log should carry.
DO_NOT_LOG = (
    "patient identifiers",
    "patient name / demographics",
    "clinical values (diagnosis, medication, notes)",
    "full request/response bodies or entity objects",
    "credentials, tokens, secrets, connection strings",
)

# --- contract and scores -----------------------------------------------------

RANKS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
RISK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
#: Full marks of each part of the score.
WEIGHTS = {
    "job_lifecycle": 15, "input_visibility": 15, "transformation_visibility": 15, "join_visibility": 15,
    "output_visibility": 15, "exception_visibility": 10, "structured_logging": 10, "run_correlation": 5,
}
#: The categories of findings that feed a part.
BUCKETS = {
    "job_lifecycle": ("JOB_START", "JOB_COMPLETION"),
    "input_visibility": ("DATASET_READ", "PARQUET_READ"),
    "transformation_visibility": (
        "FILTER", "GROUP_BY", "AGGREGATION", "DEDUPLICATION", "MAP", "REPARTITION", "SELECT", "WITH_COLUMN", "SORT", "UNION",
    ),
    "join_visibility": ("JOIN",),
    "output_visibility": ("DATASET_WRITE", "PARQUET_WRITE", "EXTERNAL_IO"),
    "exception_visibility": ("EXCEPTION",),
}
SPARK_ONLY = ("input_visibility", "job_lifecycle", "join_visibility", "transformation_visibility")

# --- project discovery -------------------------------------------------------

#: The first pattern that fits gives the version.
JAVA_VERSION = (
    r"<maven\.compiler\.(?:source|release|target)>\s*([\d.]+)\s*</",
    r"<source>\s*([\d.]+)\s*</source>",
    r"""sourceCompatibility\s*=?\s*['"]?(?:JavaVersion\.VERSION_)?([\d._]+)""",
    r"languageVersion\.set\(JavaLanguageVersion\.of\((\d+)\)\)",
)
SPARK_VERSION = (
    r"""spark-(?:core|sql)[_-][\d.]+['"]?\s*[:,]\s*['"]?([\d.]+)""",
    r"<spark\.version>\s*([\d.]+)\s*</spark\.version>",
    r"""org\.apache\.spark['"]?\s*[,:]\s*['"]?spark-[a-z]+(?:_[\d.]+)?['"]?\s*[,:]\s*['"]?([\d.]+)""",
)
#: Markers of logging frameworks.
LOGGING_MARKERS = (
    ("SLF4J", r"org\.slf4j|slf4j-api"),
    ("Log4j2", r"org\.apache\.logging\.log4j|log4j-core|log4j-api"),
    ("Log4j", r"org\.apache\.log4j|(?<!logging\.)log4j:log4j"),
    ("Logback", r"ch\.qos\.logback|logback-classic"),
    ("java.util.logging", r"java\.util\.logging"),
)
SPARK_MARKER = r"org\.apache\.spark|SparkSession|JavaSparkContext|Dataset<Row>"
SPARK_SQL_MARKER = r"spark-sql|org\.apache\.spark\.sql"
BUILD_FILES = (("pom.xml", "Maven"), ("build.gradle", "Gradle"), ("build.gradle.kts", "Gradle"))
