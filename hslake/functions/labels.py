"""Display labels of recorded values."""

#: Recorded observation states and their labels.
STATE_LABELS = {
    "hellos_observed": "ClientHello + ServerHello", "server_hello_only": "ServerHello", "retry_only": "HelloRetryRequest", "client_hello_only": "ClientHello",
    "ssh_identification": "SSH identification", "ssh_kex_offers": "SSH algorithm offers", "ssh_kex_selection": "SSH algorithm selection", "ssh_newkeys_observed": "SSH NEWKEYS observed",
    "ssh_no_common_algorithm": "SSH has no common algorithm", "wireguard_initiation": "WireGuard initiation", "wireguard_response": "WireGuard response", "wireguard_cookie_reply": "WireGuard cookie reply",
    "ike_sa_offers": "IKEv2 SA offers", "ike_sa_selection": "IKEv2 SA selection", "openvpn_control": "OpenVPN control", "openvpn_tls_client_hello": "OpenVPN ClientHello", "openvpn_tls_hellos": "OpenVPN TLS hellos",
    "smb_negotiation": "SMB negotiation", "smb_authentication": "SMB authentication", "smb_rpc_bind": "SMB pipe RPC bind", "smb_signed_message": "SMB signed message", "smb_rdma_signed_payload": "SMB RDMA signed payload",
    "smb_compressed_transform": "SMB compressed message", "smb_encrypted_transform": "SMB encrypted message", "rdp_negotiation": "RDP negotiation", "rdp_security_exchange": "RDP security exchange",
    "ldap_datagram": "LDAP datagram", "http_authentication": "HTTP authentication", "http_observed": "HTTP — unencrypted", "http_tunnel": "HTTP CONNECT tunnel", "database_negotiation": "Database negotiation",
    "ipsec_headers_observed": "IPsec headers observed", "rpc_bind": "DCE/RPC bind", "cleartext_login": "Cleartext login", "ikev1_sa_offers": "IKEv1 SA offers", "ikev1_sa_selection": "IKEv1 SA selection",
    "ikev1_key_exchange": "IKEv1 key exchange", "ikev1_auth_payload": "IKEv1 authentication payload", "ikev1_protected_exchange": "IKEv1 protected exchange", "ikev1_quick_mode": "IKEv1 Quick Mode",
    "tds_prelogin": "TDS PRELOGIN", "tds_authentication": "TDS authentication", "tds_framing": "TDS framing", "kerberos_request": "Kerberos request", "kerberos_reply": "Kerberos reply", "kerberos_error": "Kerberos error",
    "ldap_bind_request": "LDAP bind request", "ldap_bind_response": "LDAP bind response", "ldap_starttls": "LDAP StartTLS", "possible_encryption": "Possible encryption",
}
