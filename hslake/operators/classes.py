"""Classification of recorded algorithms and lists, and remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.operators.investigation import SAFE, js
from hslake.plans.registry import query

#: Post-quantum and hybrid key-exchange groups (id: components, standardization, reference).
GROUPS = {
    512: ("ML-KEM-512", "", "Draft", "draft-ietf-tls-mlkem-10"),
    513: ("ML-KEM-768", "", "Draft", "draft-ietf-tls-mlkem-10"),
    514: ("ML-KEM-1024", "", "Draft", "draft-ietf-tls-mlkem-10"),
    4585: ("secp256r1", "ML-KEM-512", "Draft", "draft-rosomakho-tls-ecdhe-mlkem512-00"),
    4586: ("ML-KEM-512", "X25519", "Draft", "draft-rosomakho-tls-ecdhe-mlkem512-00"),
    4587: ("secp256r1", "ML-KEM-768", "Standardized", "RFC 10024"),
    4588: ("ML-KEM-768", "X25519", "Standardized", "RFC 10024"),
    4589: ("secp384r1", "ML-KEM-1024", "Standardized", "RFC 10024"),
    4590: ("SM2", "ML-KEM-768", "Draft", "draft-yang-tls-hybrid-sm2-mlkem-03"),
    25497: ("X25519", "Kyber768Draft00", "Obsolete", "RFC 10024"),
    25498: ("secp256r1", "Kyber768Draft00", "Obsolete", "RFC 10024"),
}
GROUP_VALUES = ", ".join(f"({k}, '{a}', '{b}', '{s}', '{r}')" for k, (a, b, s, r) in GROUPS.items())
CLASSICAL = "(gid between 1 and 41 or gid between 256 and 260 or gid in (65281, 65282))"
GREASE = "(gid >= 0 and gid % 256 = gid // 256 and gid % 16 = 10)"
PRIVATE = "(gid between 508 and 511 or gid between 65024 and 65279)"


@query("group_class", f"""select c.id, case when gid2 is not null then case when second <> '' then 'Hybrid post-quantum' else 'Post-quantum' end when {CLASSICAL} then 'Classical' when gid is not null then 'Unknown' when dh then 'Classical' else 'Not observed' end as class,
  case when gid2 is not null then standing when {CLASSICAL} then case when gid <= 8 or gid between 15 and 21 then 'Deprecated' else 'Assigned' end when {GREASE} then 'GREASE' when {PRIVATE} then 'Private use' when gid is not null then 'Unknown' when dh then 'Not applicable' else 'Not observed' end as status,
  case when gid2 is not null then reference when {CLASSICAL} then 'IANA TLS Supported Groups' when {GREASE} then 'RFC 8701' else '' end as reference,
  case when gid2 is not null then list_filter([first, second], lambda x: x <> '') when gid is null and dh then ['Finite-field Diffie-Hellman'] else [] end as components
  from (select id, try_cast({js('selected_group_id')} as int) as gid, coalesce(try_cast({js('dh_parameter_bits')} as int) >= 0, false) as dh from connections) c left join (values {GROUP_VALUES}) g(gid2, first, second, standing, reference) on g.gid2 = c.gid""")
def group_class(j):
    """Class, standardization, reference and named components of the selected group; ids outside the table go by range."""
    gid = F.col("gid")
    dh = F.coalesce(T.json_value("crypto_json", "dh_parameter_bits").try_cast("int") >= 0, F.lit(False))
    rows = j.connections.select("id", T.json_value("crypto_json", "selected_group_id").try_cast("int").alias("gid"), dh.alias("dh"))
    table = j.spark.createDataFrame([(k, *v) for k, v in GROUPS.items()], "gid int, first string, second string, standing string, reference string")
    known, none = F.col("standing").isNotNull(), gid.isNull()
    classical = gid.between(1, 41) | gid.between(256, 260) | gid.isin(65281, 65282)
    grease = (gid >= 0) & (gid % 256 == F.floor(gid / 256)) & (gid % 16 == 10)
    private = gid.between(508, 511) | gid.between(65024, 65279)
    old = (gid <= 8) | gid.between(15, 21)
    named = F.filter(F.array("first", "second"), lambda x: x != "")
    return rows.join(F.broadcast(table), "gid", "left").select(
        "id",
        F.when(known, F.when(F.col("second") != "", "Hybrid post-quantum").otherwise("Post-quantum")).when(classical, "Classical").when(~none, "Unknown").when(F.col("dh"), "Classical").otherwise("Not observed").alias("class"),
        F.when(known, F.col("standing")).when(classical, F.when(old, "Deprecated").otherwise("Assigned")).when(grease, "GREASE").when(private, "Private use").when(~none, "Unknown").when(F.col("dh"), "Not applicable").otherwise("Not observed").alias("status"),
        F.when(known, F.col("reference")).when(classical, "IANA TLS Supported Groups").when(grease, "RFC 8701").otherwise("").alias("reference"),
        F.when(known, named).when(none & F.col("dh"), F.array(F.lit("Finite-field Diffie-Hellman"))).otherwise(F.array().cast("array<string>")).alias("components"),
    )


def signature_scheme_class(scheme: Column) -> Column:
    """Class of a signature scheme number: post-quantum code points, other assigned ones, or unknown."""
    return F.when(scheme.isNull(), "Not reported").when(scheme.between(2308, 2310) | scheme.between(2320, 2340), "Post-quantum").when(scheme.between(65024, 65535), "Unknown").when(scheme.between(513, 2307), "Classical").otherwise("Unknown")


@query("signature_class", f"select scheme, case when scheme between 2308 and 2310 or scheme between 2320 and 2340 then 'Post-quantum' when scheme between 65024 and 65535 then 'Unknown' when scheme between 513 and 2307 then 'Classical' else 'Unknown' end as class, count(*) as n from (select cast(json_extract_string(r, '$.handshake_signature_id') as int) as scheme from (select unnest(cast(json_extract({SAFE}, '$.endpoint_confirmations') as json[])) as r from connections) x) y where scheme is not null group by 1")
def signature_class(j):
    from hslake.operators.evidence import PROFILE

    reports = j.connections.select(F.explode(F.from_json(T.safe_object("crypto_json"), PROFILE)["endpoint_confirmations"]).alias("r"))
    rows = reports.select(F.col("r.handshake_signature_id").alias("scheme")).where("scheme is not null")
    return rows.groupBy("scheme").agg(F.count("*").alias("n")).select("scheme", signature_scheme_class(F.col("scheme")).alias("class"), "n")


@query("cipher_registry", "select cipher_name, regexp_extract(cipher_name, '(AES_256_GCM|AES_128_GCM|CHACHA20_POLY1305)', 1) as encryption, regexp_extract(cipher_name, '(SHA[0-9]+)$', 1) as hash, cast(nullif(regexp_extract(cipher_name, 'AES_([0-9]+)', 1), '') as int) as key_bits, contains(cipher_name, 'GCM') or contains(cipher_name, 'POLY1305') as aead, count(*) as n from connections where cipher_name <> '' group by 1")
def cipher_registry(j):
    c = F.col("cipher_name")
    rows = j.connections.where("cipher_name <> ''").groupBy("cipher_name").agg(F.count("*").alias("n"))
    bits = T.nonempty(F.regexp_extract(c, r"AES_([0-9]+)", 1)).cast("int")
    return rows.select("cipher_name", F.regexp_extract(c, "(AES_256_GCM|AES_128_GCM|CHACHA20_POLY1305)", 1).alias("encryption"), F.regexp_extract(c, r"(SHA[0-9]+)\z", 1).alias("hash"), bits.alias("key_bits"), (F.contains(c, F.lit("GCM")) | F.contains(c, F.lit("POLY1305"))).alias("aead"), "n")


@query("psk_and_exchange", f"select id, case when tls_version = 772 and {js('selected_psk_index')} is not null then case when group_name <> '' then 'PSK with key exchange' else 'PSK only' end when tls_version = 772 then 'Certificate' else 'Not observed' end as mode from connections")
def psk_and_exchange(j):
    psk = T.json_value("crypto_json", "selected_psk_index").isNotNull()
    tls13 = F.coalesce(F.col("tls_version") == 772, F.lit(False))
    mode = F.when(tls13 & psk, F.when(F.col("group_name") != "", "PSK with key exchange").otherwise("PSK only")).when(tls13, "Certificate").otherwise("Not observed")
    return j.connections.select("id", mode.alias("mode"))


@query("certificate_algorithm_class", "select public_key_class, certificate_signature_class, count(*) as n from certificates group by all")
def certificate_algorithm_class(j):
    return j.certificates.groupBy("public_key_class", "certificate_signature_class").agg(F.count("*").alias("n"))


MINIMUM_TLS, MINIMUM_DH_BITS, WARN_MISSING_EMS = 771, 2048, True
#: Findings and the legacy encryptions that the second one means.
LEGACY = ["NULL", "RC4_128", "RC4_40", "RC2_CBC_128", "RC2_CBC_40", "IDEA_CBC", "3DES_EDE", "DES40", "DES_CBC"]
LOGINS = {"SMTP": ("smtp_auth_plain_observed", "smtp_auth_login_observed"), "IMAP": ("imap_plaintext_login_observed", "imap_auth_plain_observed"), "POP3": ("pop3_plaintext_password_observed", "pop3_auth_plain_observed"), "FTP": ("ftp_plaintext_password_observed",)}


def finding_rules(field, kerberos: str) -> list[tuple[str, str]]:
    """(finding, condition); ``field`` writes the text at a path of the recorded document ('' if it isn't there), in either SQL dialect."""
    suite = lambda group: f"regexp_extract(cipher_name, '^TLS_(.+)_WITH_(.+)_(SHA|SHA256|SHA384|MD5|NULL)$', {group})"
    kex, ssh = suite(1), "tls_name like 'SSH%'"
    yes = lambda *names: " or ".join(f"{field(n)} = 'true'" for n in names)
    response = lambda side: f"coalesce(nullif({field(f'ntlm_authenticate.{side}_response')}, ''), {field(f'smb_legacy_{side}_response')})"
    tds = field("tds_negotiated_encryption")
    open_tds = yes("tds_unencrypted_login_observed")
    rules = [
        ("Protocol below configured minimum", f"coalesce(tls_version, 0) <> 0 and tls_version < {MINIMUM_TLS}"),
        ("Legacy or null encryption selected", f"{suite(2)} in ({', '.join(repr(x) for x in LEGACY)}) or {suite(2)} in ('3DES_EDE_CBC')"),
        ("Static RSA key exchange selected", f"{kex} = 'RSA'"),
        ("Anonymous authentication selected", f"lower({kex}) like '%anon'"),
        ("DH parameter size below configured minimum", f"try_cast({field('dh_parameter_bits')} as int) < {MINIMUM_DH_BITS}"),
        ("Extended master secret not selected", f"tls_version = 771 and {str(WARN_MISSING_EMS).lower()} and {field('ems_selected')} = 'false'"),
        ("TLS compression selected", f"{field('compression_method')} not in ('', '0')"),
        ("Legacy SSH key exchange selected", f"{ssh} and {field('ssh_selection.key_exchange')} = 'diffie-hellman-group1-sha1'"),
        ("Legacy SSH host-key signature selected", f"{ssh} and {field('ssh_selection.host_key')} in ('ssh-rsa', 'ssh-dss')"),
        ("Plaintext fatal alert observed", f"{field('alert_level')} = '2'"),
        ("Legacy Kerberos encryption observed", kerberos),
        ("NTLMv1 response observed", f"{response('nt')} like 'NTLMv1%'"),
        ("LM response observed", f"{response('lm')} = 'LM'"),
        ("Plaintext SMB password observed", yes("smb_legacy_plaintext_password")),
        ("SMB1 dialect selected", f"{field('smb_legacy_response_format')} <> ''"),
        ("Plaintext LDAP password observed", yes("ldap_plaintext_password")),
        ("Unsigned LDAP session observed", f"{field('ldap_session_protection')} = 'None'"),
        ("Standard RDP Security selected", f"{field('rdp_selected_protocol')} = '0' or {field('rdp_server_encryption_method')} not in ('', 'None')"),
        ("Unencrypted TDS login observed", open_tds),
        ("Unencrypted TDS session negotiated", f"not ({open_tds}) and {tds} = 'None'"),
        ("Login-only TDS encryption negotiated", f"not ({open_tds}) and {tds} = 'Login only'"),
        ("HTTP Basic credentials sent in clear", yes("http_basic_auth_observed")),
        ("Plaintext PostgreSQL password observed", yes("postgresql_cleartext_password_observed")),
        ("Plaintext MySQL password observed", yes("mysql_cleartext_password_observed")),
        ("HTTP NTLM authentication sent in clear", yes("http_ntlm_auth_observed")),
        ("HTTP Negotiate authentication sent in clear", yes("http_negotiate_auth_observed")),
    ]
    return rules + [(f"{name} login sent in clear", yes(*keys)) for name, keys in LOGINS.items()]


_members = f"list_concat([], flatten(list_transform(list_filter(json_keys({SAFE}), lambda k: k like 'krb\\_%' escape '\\'), lambda k: list_transform(list_filter(coalesce(json_keys(json_extract({SAFE}, '$.' || k)), []), lambda m: m = 'encryption' or m like '%\\_encryption' escape '\\'), lambda m: json_extract_string({SAFE}, '$.' || k || '.' || m)))))"
_DUCK_RULES = finding_rules(lambda path: f"coalesce({js(path)}, '')", f"len(list_filter(coalesce({_members}, []), lambda t: t like 'rc4%' or t like 'des%')) > 0")


def with_members(df: DataFrame) -> DataFrame:
    """Adds ``v``, the text of each member of the recorded document, and ``krb``, the encryption members of its Kerberos objects."""
    objects = "filter(map_entries(v), m -> startswith(m.key, 'krb_') and startswith(m.value, '{'))"
    listed = f"flatten(transform({objects}, m -> transform(filter(map_entries(from_json(m.value, 'map<string,string>')), x -> x.key = 'encryption' or endswith(x.key, '_encryption')), x -> x.value)))"
    return df.withColumn("v", F.coalesce(F.from_json(T.safe_object("crypto_json"), "map<string,string>"), F.create_map().cast("map<string,string>"))).withColumn("krb", F.expr(listed))


@query("kerberos_encryption", f"select id, list_sort(list_distinct({_members})) as encryptions from connections where len({_members}) > 0")
def kerberos_encryption(j):
    """Distinct encryptions that any recorded Kerberos object names; connections without one give no row."""
    rows = with_members(j.connections).select("id", F.sort_array(F.array_distinct(F.array_compact("krb"))).alias("encryptions"))
    return rows.where(F.size("encryptions") > 0)


@query("findings", "select id, [f for f in [" + ", ".join(f"case when {e} then '{n}' end" for n, e in _DUCK_RULES) + "] if f is not null] as findings from connections")
def findings(j):
    """Weak cryptography that a connection's record shows; the document is parsed once into its members' text."""
    inner = lambda name: f"from_json(v['{name}'], 'map<string,string>')"
    field = lambda path: f"coalesce({inner(path.partition('.')[0])}['{path.partition('.')[2]}'], '')" if "." in path else f"coalesce(v['{path}'], '')"
    kerberos = "exists(krb, t -> t like 'rc4%' or t like 'des%')"
    rows = with_members(j.connections)
    told = [F.when(F.expr(e), n) for n, e in finding_rules(field, kerberos)]
    return rows.select("id", F.filter(F.array(*told), lambda f: f.isNotNull()).alias("findings"))


@query("name_list_parse", f"select id, list_sort(list_distinct(list_transform(string_split(lower(concat(tls_name, ',', group_name)), ','), lambda x: trim(x)))) as names from connections")
def name_list_parse(j):
    return j.connections.select("id", F.sort_array(F.array_distinct(F.transform(F.split(F.lower(F.concat("tls_name", F.lit(","), "group_name")), ","), lambda x: F.trim(x)))).alias("names"))
