"""Web server configuration rules."""

from .model import AUTH, DESER, INFO, Rule as R, pack

RULES = pack(
    "webconfig",
    R("cfg-viewstate-mac", DESER, r"(?i)enableViewStateMac\s*=\s*[\"']false[\"']", "View state is not authenticated", "CRITICAL/HIGH",
      hit='<pages enableViewStateMac="false" />', miss='<pages enableViewStateMac="true" />'),
    R("cfg-viewstate-encryption", AUTH, r"(?i)viewStateEncryptionMode\s*=\s*[\"']Never[\"']", "View state is not encrypted", "HIGH/HIGH",
      hit='<pages viewStateEncryptionMode="Never" />', miss='<pages viewStateEncryptionMode="Always" />'),
    R("cfg-machinekey-none", DESER, r"(?i)<machineKey[^>]*validation\s*=\s*[\"']None[\"']", "Machine key validation is off", "CRITICAL/HIGH",
      hit='<machineKey validation="None" />', miss='<machineKey validation="HMACSHA256" />'),
    R("cfg-machinekey-weak", AUTH, r"(?i)<machineKey[^>]*validation\s*=\s*[\"'](?:MD5|SHA1)[\"']", "Machine key uses a weak hash", "MEDIUM/HIGH",
      hit='<machineKey validation="SHA1" />', miss='<machineKey validation="HMACSHA512" />'),
    R("cfg-forms-protection", AUTH, r"(?i)<forms[^>]*protection\s*=\s*[\"']None[\"']", "Forms ticket is unprotected", "CRITICAL/HIGH",
      hit='<forms protection="None" />', miss='<forms protection="All" />'),
    R("cfg-forms-ssl", AUTH, r"(?i)<forms[^>]*requireSSL\s*=\s*[\"']false[\"']", "Forms ticket may travel in clear", "HIGH/HIGH",
      hit='<forms requireSSL="false" />', miss='<forms requireSSL="true" />'),
    R("cfg-forms-cookieless", AUTH, r"(?i)<forms[^>]*cookieless\s*=\s*[\"'](?:true|UseUri)[\"']", "Forms ticket in the address", "HIGH/HIGH",
      hit='<forms cookieless="UseUri" />', miss='<forms cookieless="UseCookies" />'),
    R("cfg-debug", INFO, r"(?i)<compilation[^>]*debug\s*=\s*[\"']true[\"']", "Debug build in production", "HIGH/HIGH",
      hit='<compilation debug="true" />', miss='<compilation debug="false" />'),
    R("cfg-trace", INFO, r"(?i)<trace[^>]*enabled\s*=\s*[\"']true[\"']", "Tracing is on", "HIGH/HIGH",
      hit='<trace enabled="true" />', miss='<trace enabled="false" />'),
    R("cfg-session-cookieless", AUTH, r"(?i)<sessionState[^>]*cookieless\s*=\s*[\"'](?:true|UseUri)[\"']", "Session id in the address", "HIGH/HIGH",
      hit='<sessionState cookieless="true" />', miss='<sessionState cookieless="false" />'),
    R("cfg-session-timeout", AUTH, r"(?i)<sessionState[^>]*timeout\s*=\s*[\"'](?:6[1-9]|[7-9][0-9]|[0-9]{3,})[\"']", "Session lives over an hour", "LOW/MEDIUM",
      hit='<sessionState timeout="120" />', miss='<sessionState timeout="20" />'),
    R("cfg-custom-errors", INFO, r"(?i)<customErrors[^>]*mode\s*=\s*[\"']Off[\"']", "Error details are shown", "HIGH/HIGH",
      hit='<customErrors mode="Off" />', miss='<customErrors mode="On" />'),
    R("cfg-directory-browse", INFO, r"(?i)<directoryBrowse[^>]*enabled\s*=\s*[\"']true[\"']", "Directory listing is on", "MEDIUM/HIGH",
      hit='<directoryBrowse enabled="true" />', miss='<directoryBrowse enabled="false" />'),
)
