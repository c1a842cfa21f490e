"""Policies from an XML file with a closed schema: unknown settings, repeated names and bad values are refused, each with its reason."""

from __future__ import annotations

import hashlib
import re
from dataclasses import fields

from pyspark.sql import SparkSession

from hslake.operators.policy import Policy
from hslake.sources.shared import _path

MOST_BYTES, MOST_POLICIES = 256 * 1024, 128
#: The file's settings and the fields that they fill. The first two groups are text and switches, then numbers, then lists.
SETTINGS = {
    "name": "name", "protocol": "protocol", "computer": "computer", "process": "process", "serverName": "server_name",
    "enabled": "enabled", "requirePostQuantumKeyExchange": "pq_key_exchange", "requireStandardizedPqGroup": "standardized_group", "requirePostQuantumServerAuthentication": "pq_server_auth",
    "requirePostQuantumClientAuthentication": "pq_client_auth", "requireCertificateEvidence": "certificate_evidence", "requirePostQuantumCertificateSignatures": "pq_chain", "requireEndpointCompletion": "completion",
    "requirePeerVerification": "peer_verification", "requireSmbSigningRequired": "signing_required", "requireSmbSigning": "signing_observed", "requireSmbEncryption": "encryption",
    "requireLdapSaslProtection": "sasl_protection", "requireVpnAuthentication": "vpn_authentication",
    "minimumTls": "minimum_tls", "minimumSshHostKeyBits": "minimum_bits", "minimumVpnKeyBits": "minimum_bits", "minimumSmbDialect": "minimum_dialect", "minimumOpenVpnTls": "minimum_tls",
    "allowedGroups": "groups", "allowedServerSignatures": "server_schemes", "allowedClientSignatures": "client_schemes", "allowedSmbCiphers": "smb_ciphers", "allowedSmbSigningAlgorithms": "smb_signing",
    "allowedSshKeyExchanges": "kex", "allowedVpnKeyExchanges": "kex", "allowedSshHostKeys": "host_keys", "allowedSshCiphers": "ciphers", "allowedVpnCiphers": "ciphers", "allowedSshMacs": "macs",
    "allowedSshHostKeyFingerprints": "fingerprints", "allowedOpenVpnControlCiphers": "control_ciphers",
}
#: What a policy asks unless its settings say otherwise, and the families' names in the file.
DEFAULTS = {"requirePostQuantumKeyExchange": "true", "requireStandardizedPqGroup": "true", "requireEndpointCompletion": "true"}
FAMILIES = {"Tls": "TLS", "Ssh": "SSH", "Smb": "SMB", "IkeV2": "IKEv2", "WireGuard": "WireGuard", "OpenVpn": "OpenVPN", "Ldap": "LDAP"}
DIALECTS = (0, 0x0202, 0x0210, 0x0300, 0x0302, 0x0311)
#: Settings that only one family reads; two that fill one field are told apart by it.
OF_FAMILY = {"minimumTls": ["TLS"], "minimumOpenVpnTls": ["OpenVPN"], "minimumSshHostKeyBits": ["SSH"], "minimumVpnKeyBits": ["IKEv2", "WireGuard", "OpenVPN"], "allowedSshKeyExchanges": ["SSH"], "allowedVpnKeyExchanges": ["IKEv2", "WireGuard", "OpenVPN"], "allowedSshCiphers": ["SSH"], "allowedVpnCiphers": ["IKEv2", "WireGuard", "OpenVPN"]}


class PolicyFileRefused(ValueError):
    """Why a policy file isn't taken."""


def _value(setting: str, text: str):
    field = next(f for f in fields(Policy) if f.name == SETTINGS[setting])
    kind = str(field.type)
    try:
        if kind == "bool":
            return {"true": True, "false": False}[text.strip().lower()]
        if kind == "int":
            return int(text)
        if kind.startswith("tuple"):
            parts = tuple(dict.fromkeys(p.strip() for p in text.split(",") if p.strip()))
            if "int" not in kind:
                return parts
            ids = tuple(int(p, 0) for p in parts)
            if not all(0 <= i <= 65535 for i in ids):
                raise ValueError(text)
            return ids
    except (KeyError, ValueError):
        raise PolicyFileRefused(f"{setting} can't be {text!r}") from None
    return text


def policy_of(settings: dict[str, str]) -> Policy:
    """One policy from the settings of its element."""
    unknown = sorted(set(settings) - set(SETTINGS))
    if unknown:
        raise PolicyFileRefused(f"unknown setting {', '.join(unknown)}")
    family = FAMILIES.get(settings.get("protocol", "Tls"))
    if family is None:
        raise PolicyFileRefused(f"unsupported protocol {settings['protocol']}")
    given = {k: _value(k, v) for k, v in {**DEFAULTS, **settings}.items() if k != "protocol"}
    if given.get("minimumSmbDialect", 0) not in DIALECTS:
        raise PolicyFileRefused("unsupported SMB dialect")
    for scope in ("name", "computer", "process", "serverName"):
        if not given.get(scope, "*").strip() or len(given.get(scope, "*")) > 256:
            raise PolicyFileRefused("a policy has a name, and scopes of 1 to 256 characters")
    if any(not re.fullmatch("[0-9A-Fa-f]{64}", x) for x in given.get("allowedSshHostKeyFingerprints", ())):
        raise PolicyFileRefused("SSH fingerprints are hexadecimal SHA-256 values")
    filled = {SETTINGS[k]: v for k, v in given.items() if family in OF_FAMILY.get(k, [family])}
    try:
        return Policy(**({"name": "Policy", "protocol": family} | filled))
    except AssertionError as e:
        raise PolicyFileRefused(str(e)) from None


def load_policies(spark: SparkSession, path: str) -> tuple[list[Policy], str]:
    """The policies of a file and their fingerprint, SHA-256 over all their settings in order.

    The file has one ``policies`` element whose ``policy`` elements hold settings as attributes only. It is read by Spark's XML source; every column that isn't a setting,
    be it an attribute, a child or a text, refuses the file. At most 256 KiB and 128 policies of different names, in any case of letters.
    """
    at, fs = _path(spark, path)
    if fs.getFileStatus(at).getLen() > MOST_BYTES:
        raise PolicyFileRefused("the file exceeds 256 KiB")
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).option("mode", "PERMISSIVE").option("attributePrefix", "@").option("valueTag", "#text")
    sections = read("policies").load(path)
    extra = sorted(set(sections.columns) - {"policy"})
    if extra or sections.count() != 1:
        raise PolicyFileRefused(f"expected one policies section of policy elements, not {', '.join(extra) or 'none or several'}")
    rows = read("policy").load(path)
    unknown = sorted(c for c in rows.columns if not c.startswith("@"))
    if unknown:
        raise PolicyFileRefused(f"a policy holds more than settings: {', '.join(unknown)}")
    policies = [policy_of({c[1:]: v for c, v in r.asDict().items() if v is not None}) for r in rows.take(MOST_POLICIES + 1)]
    if len(policies) > MOST_POLICIES or len({p.name.lower() for p in policies}) != len(policies):
        raise PolicyFileRefused("policy names are unique; at most 128 policies are supported")
    return policies, fingerprint(policies)


def fingerprint(policies: list[Policy]) -> str:
    return hashlib.sha256("\n".join(";".join(f"{f.name}={getattr(p, f.name)!r}" for f in fields(p)) for p in policies).encode()).hexdigest()


def policy_xml(policies: list[Policy]) -> str:
    """The file that ``load_policies`` reads the same policies from."""
    from xml.sax.saxutils import quoteattr

    family = {v: k for k, v in FAMILIES.items()}
    lines = []
    for p in policies:
        settings = {"name": p.name, "protocol": family[p.protocol]}
        for setting, name in SETTINGS.items():
            value = getattr(p, name)
            if setting in settings or p.protocol not in OF_FAMILY.get(setting, [p.protocol]):
                continue
            settings[setting] = str(value).lower() if isinstance(value, bool) else ",".join(map(str, value)) if isinstance(value, tuple) else str(value)
        lines.append("    <policy " + " ".join(f"{k}={quoteattr(v)}" for k, v in settings.items()) + "/>")
    return "<configuration>\n  <policies>\n" + "\n".join(lines) + "\n  </policies>\n</configuration>\n"
