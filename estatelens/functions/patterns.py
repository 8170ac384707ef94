"""Regular expressions and fixed values shared by the text and ETL functions.

Quantifiers are possessive wherever a run can be long: the JVM then matches them in a loop rather than by recursion,
so whole texts of any length are safe.
"""

# ---- Fixed values: expression syntax ----------------------------------------------------------------------------

WHITESPACE = " \t\n\r\x0b\x0c\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
LINE_COMMENT = r"//[^\n]*+"
STRING = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'  # unterminated runs to the end of the text
CLOSED_STRING = r'"[^"]*+(?:""[^"]*+)*+"'
QUALIFIED = r"(?:'[^']++'|[A-Za-z_]\w*+)\[[^\]]*+\]"
QUALIFIED_PARTS = r"^(?:'([^']++)'|([A-Za-z_]\w*+))\[([^\]]*+)\]$"
BARE = r"\[([^\]]+)\]"
TOKEN = r"\[([^\[\]]*)\]"
EXTERNAL = (
    r'(?i)EXTERNALMEASURE\s*\(\s*"([^"]*+(?:""[^"]*+)*+)"\s*,\s*(\w+)\s*,\s*'
    r'"DirectQuery to AS - ([^"]*+(?:""[^"]*+)*+)"\s*\)'
)
REMOTE_PREFIX = "DirectQuery to AS - "
REMOTE_CLUSTER = r'(?i)AnalysisServices\.Database\s*\(\s*"([^"]+)"'
REMOTE_CLUSTER_AND_DATABASE = r'(?i)AnalysisServices\.Database\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"'
USERELATIONSHIP = r"(?i)USERELATIONSHIP\s*\(([^)]*)"
AUTO_DATE = r"^(LocalDateTable_|DateTableTemplate_)"
FUNCTION_PARAMETERS = r"(?s)^\(\s*(.*?)\s*\)\s*=>"
FUNCTION_HEAD = r"(?s)^\(.*?\)\s*=>\s*"

# ---- Fixed values: limits ---------------------------------------------------------------------------------------

BODY_CAP = 10_000
LONG_BODY_LINES = 30
DUPLICATE_MIN_LENGTH = 10
COHORT_MIN_MEMBERS = 3

# ---- Fixed values: data-source keywords, in match order; the first keyword present names the source -------------
# (keyword, case sensitive, label)

SOURCE_KEYWORDS = [
    ("Binary.FromText(", True, "Inline (encoded)"),
    ("Table.FromRows(", True, "Inline data"),
    ("#table(", True, "Inline data"),
    ("parquet.document(", False, "Parquet"),
    ("sql.database(", False, "SQL Server"),
    ("sql.databases(", False, "SQL Server"),
    ("odata.feed(", False, "OData"),
    ("excel.workbook(", False, "Excel"),
    ("csv.document(", False, "CSV"),
    ("json.document(", False, "JSON"),
    ("xml.tables(", False, "XML"),
    ("web.contents(", False, "Web"),
    ("web.page(", False, "Web (HTML)"),
    ("folder.files(", False, "Folder"),
    ("folder.contents(", False, "Folder"),
    ("sharepoint.tables(", False, "SharePoint"),
    ("sharepoint.files(", False, "SharePoint Files"),
    ("sharepoint.contents(", False, "SharePoint"),
    ("azurestorage.blobs(", False, "Azure Blob Storage"),
    ("azurestorage.datalake(", False, "Azure Data Lake"),
    ("azurestorage.tables(", False, "Azure Table Storage"),
    ("snowflake.databases(", False, "Snowflake"),
    ("salesforce.data(", False, "Salesforce"),
    ("salesforce.reports(", False, "Salesforce Reports"),
    ("postgresql.database(", False, "PostgreSQL"),
    ("mysql.database(", False, "MySQL"),
    ("oracle.database(", False, "Oracle"),
    ("teradata.database(", False, "Teradata"),
    ("analysisservices.database(", False, "Analysis Services"),
    ("powerbi.dataflows(", False, "Power BI Dataflow"),
    ("powerplatform.dataflows(", False, "Power Platform Dataflow"),
    ("commondataservice.", False, "Dataverse"),
    ("cds.contents(", False, "Dataverse"),
    ("adobeanalytics.", False, "Adobe Analytics"),
    ("googleanalytics.", False, "Google Analytics"),
    ("exchange.contents(", False, "Exchange"),
    ("access.database(", False, "Access"),
    ("hdfs.files(", False, "HDFS"),
    ("azurecosmosdb.", False, "Cosmos DB"),
    ("amazonredshift.", False, "Amazon Redshift"),
    ("amazonathena.", False, "Amazon Athena"),
    ("googlebigquery.", False, "BigQuery"),
    ("bigquery.database(", False, "BigQuery"),
    ("databricks.", False, "Databricks"),
]
SOURCE_UNKNOWN = "Unknown / M"

# ---- Fixed values: source types that live in files, grouped by folder -------------------------------------------

FILE_SOURCE_TYPES = ["Parquet", "Excel", "CSV", "JSON", "XML", "Access", "Inline (encoded)", "Inline data"]

# ---- Fixed values: physical source shapes -----------------------------------------------------------------------

CONNECTOR_DATABASE = r'\b([A-Z][A-Za-z0-9]*)\.(?:Database|Databases|DataSource)\s*\(\s*"([^"]*)"(?:\s*,\s*"([^"]*)")?'
NAV_SCHEMA_ITEM = r'\{\s*\[\s*Schema\s*=\s*"([^"]+)"\s*,\s*Item\s*=\s*"([^"]+)"'
NAV_ITEM_SCHEMA = r'\{\s*\[\s*Item\s*=\s*"([^"]+)"\s*,\s*Schema\s*=\s*"([^"]+)"'
BIGQUERY = r"GoogleBigQuery\.Database|\bBigQuery\.Database"
BIGQUERY_PROJECT = r'GoogleBigQuery\.Database\s*\(\s*"([^"]+)"'
NAV_NAME = r'\{\s*\[\s*Name\s*=\s*"[^"]+"(?:\s*,\s*Kind\s*=\s*"[^"]+")?[^}]*\}'
NAV_NAME_PARTS = r'^\{\s*\[\s*Name\s*=\s*"([^"]+)"(?:\s*,\s*Kind\s*=\s*"([^"]+)")?'
FILE_DOCUMENT = (
    r'\b(Csv|Excel|Parquet|Json|Xml|Html|Pdf)\.(?:Document|Workbook|Table|Tables)\s*\(\s*File\.Contents\s*\(\s*"([^"]+)"'
)
FILE_CONTENTS = r'\bFile\.Contents\s*\(\s*"([^"]+)"'
WEB_CONTENTS = r'\bWeb\.Contents\s*\(\s*"([^"]+)"'
SHAREPOINT = r'\bSharePoint\.(?:Files|Tables|Contents)\s*\(\s*"([^"]+)"'
URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]+)?([^?#]*)"
FILE_KINDS = {"Csv": "CSV", "Excel": "Excel", "Parquet": "Parquet", "Json": "JSON", "Xml": "XML", "Html": "HTML", "Pdf": "PDF"}

# ---- Fixed values: ETL step classification ----------------------------------------------------------------------

STEP_NAVIGATION = r"\{\s*\[\s*(?:Schema|Item|Name|Kind)\s*=[^}]*\}\s*\[\s*(?:Data|Schema|Item|Name)\s*\]"
STEP_LITERAL = r"(Table\.FromRows|Table\.FromList|Table\.FromRecords|Table\.FromColumns|#table)\s*\("
STEP_CONNECTOR = (
    r"\b(?:Sql|Odbc|OleDb|Oracle|Snowflake|GoogleBigQuery|BigQuery|AzureStorage|AzureBlob|AzureDataLakeStorage|AzureSynapse"
    r"|AmazonRedshift|AmazonAthena|AmazonS3|Databricks|Salesforce|SharePoint|Dataverse|Cds|MySql|PostgreSQL|Db2|Teradata|Vertica"
    r"|Exasol|Hive|Impala|Sap|Mongo|Cosmos|Hdfs|Web|File|Csv|Excel|Json|Xml|Html|Value|AnalysisServices|Pq|PowerBI|Folder)"
    r"\.(?:Database|Contents|DataSource|Workbook|Document|Files|Folders|Tables|NativeQuery|DataFeeds|Schemas)\s*\("
)
STEP_FIRST_CALL = r"\b([A-Z][A-Za-z0-9]*(?:\.[A-Za-z][A-Za-z0-9]*)+)\s*\("
STEP_FUNCTIONS = [
    ("Table.SelectColumns", "projection"),
    ("Table.RemoveColumns", "projection"),
    ("Table.ReorderColumns", "projection"),
    ("Table.RenameColumns", "rename"),
    ("Table.SelectRows", "filter"),
    ("Table.RemoveRowsWithErrors", "filter"),
    ("Table.Distinct", "filter"),
    ("Table.NestedJoin", "join"),
    ("Table.Join", "join"),
    ("Table.Merge", "join"),
    ("Table.Combine", "union"),
    ("List.Combine", "union"),
    ("Table.AddColumn", "addColumn"),
    ("Table.AddIndexColumn", "addColumn"),
    ("Table.AddConditionalColumn", "addColumn"),
    ("Table.TransformColumnTypes", "typeChange"),
    ("Table.TransformColumns", "typeChange"),
    ("Table.ExpandTableColumn", "expand"),
    ("Table.ExpandRecordColumn", "expand"),
    ("Table.ExpandListColumn", "expand"),
]
STEP_PAIR = r'\{\s*"[^"]*"\s*,\s*(?:"[^"]*"|type\s+[A-Za-z0-9_.]+)\s*\}'

# ---- Fixed values: visuals --------------------------------------------------------------------------------------

SLICER_TYPES = ["slicer", "listSlicer", "textSlicer", "advancedSlicerVisual"]
VISUAL_CATEGORIES = [
    ("table", ["tableex", "pivottable"]),
    ("card", ["card", "cardvisual", "cardnew", "multirowcard", "kpi", "gauge"]),
    ("slicer", ["slicer", "listslicer", "textslicer", "advancedslicervisual"]),
    ("map", ["map", "filledmap", "azuremap", "shapemap"]),
    ("ai", ["decompositiontreevisual", "qnavisual", "keyinfluencers"]),
    ("chart", ["treemap", "funnel", "ribbon", "waterfall"]),  # and every type whose name contains "chart"
]
DEFAULT_PAGE_SIZE = (1280.0, 720.0)
DEFAULT_VISUAL_SIZE = (100.0, 60.0)


# ---- Nesting ----------------------------------------------------------------------------------------------------

NESTING_DEPTH = 24


def nested(opening: str, closing: str, depth: int = NESTING_DEPTH) -> str:
    """A balanced group of the given bracket classes, strings inside skipped, down to ``depth`` levels."""
    plain = rf'[^"{opening}{closing}]++|{CLOSED_STRING}'
    pattern = rf"[{opening}](?:{plain})*+[{closing}]"
    for _ in range(depth - 1):
        pattern = rf"[{opening}](?:{plain}|{pattern})*+[{closing}]"
    return pattern
