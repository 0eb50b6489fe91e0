"""Values that must stay equal to the original tool's for equal results.

FIXED VALUES -- kept verbatim, in their natural order.
"""

# Vendor stop words (index order of the shipped word list).
STOP_WORDS = [
    "inc", "project", "software", "ltd", "com", "llc", "studios", "team",
    "corporation", "gmbh", "co", "the", "entertainment", "technologies",
    "systems", "studio", "technology", "limited", "solutions", "media",
    "development", "group", "org", "interactive", "net", "www", "corp", "and",
    "digital", "ab", "of",
]

# Characters turned into blanks before splitting names into tokens.
PUBLISHER_SPLIT_CHARS = "_.,()+!"
VENDOR_SPLIT_CHARS = "-_"

# Ordered CVSS v2 levels, least to most severe.
COMPLEXITY_LEVELS = ["HIGH", "MEDIUM", "LOW"]
VECTOR_LEVELS = ["LOCAL", "ADJACENT_NETWORK", "NETWORK"]
EASY_COMPLEXITY = ["LOW", "MEDIUM"]
REMOTE_VECTOR = ["NETWORK", "ADJACENT_NETWORK"]
CRIT_LEVELS = ["None", "Low", "Medium", "High"]
HIGH_SCORE_ABOVE = 7.0
LOW_SCORE_BELOW = 4.0

# Report pivot columns (alphabetical, as the pivot lists them).
CRIT_PIVOT = ["High", "Low", "Medium"]

# Sample company sites per region.
REGION_A_SITES = ["NTH", "WST"]
REGION_B_SITES = ["STH", "EST"]
REGION_UNKNOWN = "Unknown"

# Host function from the distinguished name's OU.
HOST_FN_PATTERN = r"ou=[0-9A-Za-z_ ]*(desktop|laptop|server)"

# CPE 2.3 name parts; OS and hardware entries.
CPE23_PATTERN = r"(?i)cpe:2.3:a:([^:]*):([^:]*):?([^:]*):"
CPE23_NOT_APP = r"(?i)cpe:2.3:[oh]:"
CPE22_NOT_APP = r"(?i)cpe:/[oh]:"

# Java release normalisation (JDK / JRE CPE 2.3 names).
JAVA_VENDORS = ["oracle", "sun"]
JAVA_PRODUCTS = ["jre", "jdk"]
JAVA_UPDATE_PATTERN = r"(?i)cpe:2.3:a:(oracle|sun):(jdk|jre):1.([0-9.]*):update[_]*([0-9]*)"
JAVA_RELEASE_PATTERN = r"(?i)cpe:2.3:a:(oracle|sun):(jdk|jre):1.([0-9._]*):"

# Never-matched vendor and the WebEx skip rule.
SKIP_VENDOR = "microsoft"
WEBEX_VENDOR = "cisco"
WEBEX_TOKEN = "webex"
NO_VERSION = "-"

# Candidate gates.
VENDOR_MIN_CLEAN_LEN = 2
TITLE_GATE = 70
VERSION_RATIO_GATE = 90

# Report sizes.
TOP_HIGH_K = 25
TOP_SITES_K = 10
TOP_CATALOGUE_K = 10

# Classifier feature order (model inputs, order matters).
VENDOR_KEYS = ["publisher0", "vendor_X"]
VENDOR_FEATURES = [
    "fz_ptl_ratio", "fz_ptl_tok_sort_ratio", "fz_ratio", "fz_tok_set_ratio",
    "fz_uwratio", "ven_len", "pu0_len",
]
VENDOR_TOKENS = ["pub0_cln", "ven_cln"]
SOFTWARE_KEYS = [
    "vendor_X", "software_X", "title_X", "DisplayName0", "release_X", "Version0",
]
SOFTWARE_FEATURES = [
    "fz_ratio", "fz_ptl_ratio", "fz_tok_set_ratio", "fz_ptl_tok_sort_ratio",
    "fz_uwratio", "fz_rel_ratio", "fz_rel_ptl_ratio", "titlX_len", "DsplyNm0_len",
]

# Random forest settings of the two trained models.
VENDOR_FOREST = dict(numTrees=40, impurity="entropy", maxDepth=3,
                     featureSubsetStrategy="3", minInstancesPerNode=2)
SOFTWARE_FOREST = dict(numTrees=55, impurity="gini", maxDepth=3,
                       featureSubsetStrategy="4", minInstancesPerNode=3)

# Feed refresh.
CVE_FILE_PREFIX = "nvdcve-2.0-"
CPE_MAX_AGE_DAYS = 7
