"""URL columns: redaction, class, authority, host policy."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskledger.catalog import names, patterns as P
from riskledger.functions.regex import to_java
from riskledger.functions.signals import contains_any


def redact_url(url: Column) -> Column:
    bare = F.regexp_replace(url, to_java(P.URL_USERINFO), "://")
    return F.regexp_replace(bare, to_java(P.URL_CREDENTIAL_PARAM), "$1$2=REDACTED")


def url_class(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(contains_any(low, names.REGISTRY_URL_PARTS), "package-registry")
            .when(contains_any(low, names.LOCAL_URL_PARTS), "local-endpoint")
            .otherwise("outbound-url"))


def is_noisy_url(url: Column) -> Column:
    return contains_any(F.lower(url), names.NOISY_URL_PARTS)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(url)


def url_authority(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)


def display_host(url: Column) -> Column:
    return F.substring_index(after_scheme(url), "/", 1)


def strip_port(authority: Column) -> Column:
    colons = F.length(authority) - F.length(F.replace(authority, F.lit(":"), F.lit("")))
    return (F.when(authority.startswith("["),
                   F.regexp_extract(authority, r"^\[([^\]]*)", 1))
            .when(colons == 1, F.substring_index(authority, ":", 1))
            .otherwise(authority))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRIVATE_V4 = (rf"^(?:(?:127|10)\.{_OCTET}\.{_OCTET}\.{_OCTET}"
              rf"|172\.(?:1[6-9]|2[0-9]|3[01])\.{_OCTET}\.{_OCTET}"
              rf"|192\.168\.{_OCTET}\.{_OCTET})$")
# unique-local fc00::/7 and link-local fe80::/10, judged by the first group
PRIVATE_V6 = r"^(?:f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):[0-9a-f:.]*$"
LOOPBACK_V6 = r"^(?:0{1,4}:){7}0{0,3}1$|^(?:0{1,4}:){0,6}:(?:0{1,4}:){0,6}0{0,3}1$"


def is_private_host(host: Column) -> Column:
    low = F.lower(host)
    return ((low == "localhost") | (low == "::1") | low.rlike(PRIVATE_V4)
            | low.rlike(PRIVATE_V6) | low.rlike(LOOPBACK_V6))


def endpoint_status(url: Column, allow_public: bool = False) -> Column:
    """``allowed`` or the reason why an endpoint is refused."""
    scheme = F.substring_index(url, "://", 1)
    host = strip_port(F.substring_index(after_scheme(url), "/", 1))
    private = is_private_host(host)
    status = (F.when(F.locate("://", url) == 0, "missing_scheme")
              .when(~scheme.isin("http", "https"), "unsupported_scheme")
              .when(host == "", "no_host")
              .when((scheme == "http") & ~private, "public_http"))
    if not allow_public:
        status = status.when(~private, "public_not_allowed")
    return status.otherwise("allowed")


def sanitize_remote(url: Column) -> Column:
    """Git remote without credentials; ``unknown`` for local or odd forms."""
    clean = F.trim(url)
    scheme = F.substring_index(clean, "://", 1)
    no_user = F.regexp_replace(after_scheme(clean), r"^[^/@]*@", "")
    scp = F.concat(F.lit("ssh://"), F.regexp_extract(clean, r"^git@([^:]*):", 1), F.lit("/"),
                   F.regexp_replace(F.regexp_extract(clean, r"^git@[^:]*:(.*)$", 1), r"^/+", ""))
    return (F.when(clean.isNull() | (clean == ""), "unknown")
            .when((F.locate("://", clean) == 0) & clean.rlike(r"^git@[^:]*:"), scp)
            .when(F.locate("://", clean) == 0, "unknown")
            .when(scheme.isin("https", "http", "ssh", "git"),
                  F.concat(scheme, F.lit("://"), no_user))
            .otherwise("unknown"))
