"""Built-in rule packs over a fleet's inventory tables.

Inventory tables, each with a ``server`` column (any may be missing):
settings(name, value) · servers(version, build, error_logs, windows_auth_only, audit_level) ·
databases(name, state, is_trustworthy, page_verify, containment, is_auto_close, is_encrypted,
recovery_model, created) · server_objects(kind, name, is_default, is_disabled, is_shipped) ·
logins(login_id, name, type, is_disabled, is_policy_checked, is_expiration_checked,
days_until_expiration, password_set, password_hash, sid) ·
db_users(database, user_id, name, type, auth, sid, is_fixed_role) ·
server_permissions(grantee, permission, state, class, target) ·
role_members(database, role, member) · db_permissions(database, grantee, permission, state,
object_name) · modules(database, name, definition, is_shipped, is_auto_executed, execute_as) ·
assemblies(database, name, is_user_defined, permission_set) ·
files(database, path) · backups(database, type, start, finish, device_type, path, is_encrypted) ·
sessions(login, login_type, auth_scheme, net_transport) · linked_servers(name, is_linked,
uses_self_credential) · log(log_date, process, text) · proxies(name, principal) ·
supported(version, latest_build).
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.graph import reachable_to
from watchloom.operators.joins import only_kind_recently
from watchloom.operators.aggregates import stale_having
from watchloom.operators.rules import Rule, dictionary_match, secret_candidates

# Server-wide rights that amount to control of the server.
CONTROL_RIGHTS = [
    "Administer bulk operations", "Alter any availability group", "Alter any connection",
    "Alter any credential", "Alter any database", "Alter any endpoint", "Alter any event notification",
    "Alter any event session", "Alter any linked server", "Alter any login", "Alter any server audit",
    "Alter any server role", "Alter resources", "Alter server state", "Alter Settings", "Alter trace",
    "Authenticate server", "Control server", "Create any database", "Create availability group",
    "Create DDL event notification", "Create endpoint", "Create server role",
    "Create trace event notification", "Shutdown",
]
ADMIN_ROLES = ["sysadmin", "securityadmin"]
# Event sessions that come with the server.
STOCK_EVENT_SESSIONS = [
    "system_health", "StretchDatabase_Health", "telemetry_xevents", "hkenginexesession",
    "sp_server_diagnostics session", "AlwaysOn_health",
]
# Public sample databases.
SAMPLE_DATABASES = ["pub", "Northwind", "AdventureWorks", "AdventureWorksLT", "AdventureWorksDW", "WideWorldImporters", "WideWorldImportersDW"]
# Text fragments that show dynamic statements in code.
DYNAMIC_CODE = ["EXEC (", "EXEC(", "EXECUTE (", "EXECUTE(", "sp_executesql"]

# Fixed values: (code, category, setting, value that is an issue).
SETTING_CHECKS = [
    (4, "Configuration", "Ad Hoc Distributed Queries", 1),
    (5, "Configuration", "cross db ownership chaining", 1),
    (8, "Configuration", "default trace enabled", 0),
    (9, "Configuration", "scan for startup procs", 1),
    (10, "Configuration", "Database Mail XPs", 1),
    (11, "Configuration", "SQL Mail XPs", 1),
    (12, "Configuration", "remote admin connections", 0),
    (13, "Configuration", "remote access", 1),
    # the check flags the setting when it is off
    (14, "Configuration", "SMO and DMO XPs", 0),
    (200, "Programming", "xp_cmdshell", 1),
    (201, "Programming", "Ole Automation Procedures", 1),
    (202, "Programming", "clr enabled", 1),
    (204, "Programming", "external scripts enabled", 1),
]

# What to do about an issue, by rule.
HOW_TO_FIX = {
    1: "Switch the trustworthy property off and sign the modules that relied on it.",
    2: "Audit failed logins in the server properties.",
    3: "Allow domain authentication only.",
    4: "Switch the setting off and define linked servers for known sources.",
    5: "Switch the setting off; grant rights on the objects of the other database.",
    7: "Set page verification to checksums and rebuild the pages over time.",
    8: "Switch the default trace on again.",
    9: "Switch the scan off unless a known startup procedure needs it.",
    10: "Switch database mail off where no job sends mail.",
    11: "Switch the old mail procedures off.",
    12: "Switch remote administrator connections on, so that a hanging server can be reached.",
    13: "Switch remote access off.",
    14: "Switch the management procedures on, or retire the tools that need them.",
    15: "Review each server trigger and drop those without an owner.",
    16: "Stop traces that nobody evaluates.",
    17: "Stop event sessions that nobody evaluates.",
    18: "Keep contained databases open.",
    19: "Keep at least twelve error logs.",
    20: "Give contained databases domain users instead of passwords.",
    100: "Find the source of the attempts and block it or mend its configuration.",
    101: "Disable or rename the default administrator login.",
    102: "Link the user to a login or drop it.",
    103: "Enforce policy and expiration for the login.",
    104: "Change the password and let it expire.",
    105: "Change the password to one that no word list holds.",
    106: "Drop users without any right.",
    107: "Register service principal names so that sessions use Kerberos.",
    108: "Revoke the right from public and grant it by name.",
    109: "Replace built-in groups by named domain groups.",
    110: "Replace local groups by domain groups.",
    111: "Revoke rights of public beyond the stock ones.",
    112: "Name the users of each job proxy.",
    200: "Switch the shell procedure off.",
    201: "Switch automation procedures off.",
    202: "Switch managed code off where no assembly needs it.",
    203: "Rebuild assemblies with safe access.",
    204: "Switch external scripts off.",
    300: "Encrypt the database at rest.",
    301: "Back the database up and repair its schedule.",
    302: "Encrypt backups.",
    303: "Back the log up or use simple recovery.",
    304: "Use file extensions that malware doesn't look for.",
    305: "Use a backup extension that malware doesn't look for.",
    306: "Copy backups to another medium.",
    400: "Revoke control-level rights; grant the few that are needed.",
    401: "Remove members that don't administer the server.",
    402: "Revoke the right to impersonate any login.",
    403: "Revoke impersonation of logins that isn't used.",
    404: "Break the chain of impersonations that leads to an administrator.",
    405: "Remove members that don't own the database.",
    406: "Revoke impersonation of users that isn't used.",
    407: "Revoke the rights of the public role.",
    408: "Revoke the rights of the guest user.",
    409: "Revoke the right to load unsafe assemblies.",
    410: "Revoke rights on extended procedures.",
    500: "Let modules run as their caller.",
    501: "Bind parameters instead of joining text, and quote names.",
    502: "Move shell calls to jobs outside the database.",
    503: "Replace automation objects.",
    504: "Review startup procedures and clear the flag.",
    505: "Grant rights by deployment scripts.",
    506: "Map linked-server logins to the caller.",
    605: "Move to a supported version.",
    606: "Install the latest build.",
    607: "Drop sample databases.",
}
TITLES_PT = {
    1: "Bancos confiáveis", 2: "Falhas de login sem auditoria", 3: "Logins com senha aceitos", 4: "Consultas distribuídas ad hoc",
    5: "Encadeamento de propriedade entre bancos", 7: "Bancos sem checksum de página", 8: "Rastreamento padrão desligado", 9: "Procedimentos de inicialização",
    10: "Correio do banco ligado", 11: "Correio antigo ligado", 12: "Conexão administrativa remota desligada", 13: "Acesso remoto ligado",
    14: "Procedimentos de gerência desligados", 15: "Gatilhos de servidor", 16: "Rastreamentos extras", 17: "Sessões de eventos extras",
    18: "Bancos contidos que se fecham", 19: "Poucos logs de erro guardados", 20: "Usuários com senha em bancos contidos",
    100: "Tentativas de login falhas", 101: "Login administrador padrão ativo", 102: "Usuários sem login", 103: "Logins sem política de senha",
    104: "Senhas antigas", 105: "Senhas adivinháveis", 106: "Usuários sem direitos", 107: "Sessões de domínio sem Kerberos",
    108: "Todos veem todos os bancos", 109: "Grupos internos como logins", 110: "Grupos locais como logins", 111: "Direitos de public", 112: "Proxies abertos a public",
    200: "Shell ligado", 201: "Automação ligada", 202: "Código gerenciado ligado", 203: "Assemblies inseguros", 204: "Scripts externos ligados",
    300: "Bancos sem criptografia", 301: "Bancos sem backup recente", 302: "Backups sem criptografia", 303: "Recuperação completa sem backup de log",
    304: "Extensões padrão de arquivos", 305: "Extensão padrão de backup", 306: "Backups só em disco",
    400: "Direitos de controle do servidor", 401: "Membros de papéis administrativos", 402: "Pode personificar qualquer login", 403: "Pode personificar um login",
    404: "Pode tornar-se administrador", 405: "Donos de banco", 406: "Pode personificar um usuário", 407: "Direitos do papel public",
    408: "Direitos do usuário guest", 409: "Pode carregar assemblies inseguros", 410: "Direitos em procedimentos estendidos",
    500: "Módulos que executam como outro", 501: "Módulos com comandos dinâmicos", 502: "Módulos que chamam o shell", 503: "Módulos com automação",
    504: "Procedimentos de inicialização", 505: "Módulos que concedem direitos", 506: "Servidores vinculados com usuário fixo",
    605: "Versão sem suporte", 606: "Versão desatualizada", 607: "Bancos de exemplo instalados",
}


def _in(col: str, values: list[str]) -> str:
    listed = ", ".join("'" + v.lower().replace("'", "''") + "'" for v in values)
    return f"lower({col}) IN ({listed})"


def _contains_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w.lower()}')" for w in words) + ")"


def privileged_logins(tables: dict[str, DataFrame]) -> DataFrame:
    """(node): (server, login) with control rights or in an admin role of that server."""
    rights = [*CONTROL_RIGHTS, "IMPERSONATE ANY LOGIN"]
    granted = tables["server_permissions"].where(f"class = 'SERVER' AND state IN ('G', 'W') AND {_in('permission', rights)}")
    members = tables["role_members"].where("database IS NULL AND " + _in("role", ADMIN_ROLES))
    return granted.select(_login("grantee").alias("node")).union(members.select(_login("member").alias("node"))).distinct()


def _login(name: str) -> Column:
    """A login is known by its server and name."""
    return F.struct("server", F.col(name).alias("login"))


def posture_pack(as_of: datetime) -> list[Rule]:
    """Security-posture checks that inventory tables can answer."""
    now = f"timestamp_ntz'{as_of:%Y-%m-%d %H:%M:%S}'"
    week_ago = f"timestamp_ntz'{as_of - timedelta(days=7):%Y-%m-%d %H:%M:%S}'"
    rules = [
        Rule(code, cat, f"Setting '{name}'", "settings", f"lower(name) = '{name.lower()}' AND value = {bad}", detail=("server", "name", "value"))
        for code, cat, name, bad in SETTING_CHECKS
    ]

    def row(code, category, title, table, where, *detail):
        rules.append(Rule(code, category, title, table, where, detail=detail or ("server",)))

    def frame(code, category, title, needs, build, *detail):
        rules.append(Rule(code, category, title, build=build, needs=tuple(needs), detail=detail))

    cfg, usr, prg, dat, per, cod, ins = (
        "Configuration", "User security", "Programming", "Data protection", "Permissions", "Code", "Installation",
    )
    row(1, cfg, "Trustworthy databases", "databases", "is_trustworthy AND name <> 'msdb'", "server", "name")
    row(2, cfg, "Failed logins not audited", "servers", "audit_level NOT IN (2, 3)", "server", "audit_level")
    row(3, cfg, "Password logins accepted", "servers", "NOT windows_auth_only", "server")
    row(7, cfg, "Databases without page checksums", "databases", "page_verify <> 'CHECKSUM' AND state = 'ONLINE'", "server", "name")
    row(15, cfg, "Server triggers", "server_objects", "kind = 'TRIGGER' AND NOT is_shipped AND NOT is_disabled", "server", "name")
    row(16, cfg, "Extra traces", "server_objects", "kind = 'TRACE' AND NOT is_default", "server", "name")
    row(17, cfg, "Extra event sessions", "server_objects", "kind = 'EVENT_SESSION' AND NOT " + _in("name", STOCK_EVENT_SESSIONS), "server", "name")
    row(18, cfg, "Contained databases that close themselves", "databases", "containment <> 0 AND is_auto_close", "server", "name")
    row(19, cfg, "Few error logs kept", "servers", "coalesce(error_logs, 0) < 12", "server", "error_logs")

    def contained_sql_users(t):
        contained = t["databases"].where("containment <> 0").select("server", F.col("name").alias("database"))
        return t["db_users"].where("auth = 'DATABASE' AND name <> 'dbo'").join(contained, ["server", "database"], "left_semi")

    frame(20, cfg, "Password users in contained databases", ["databases", "db_users"], contained_sql_users, "server", "database", "name")

    row(100, usr, "Failed login attempts", "log", "contains(lower(text), 'login failed')", "server", "log_date", "text")
    row(101, usr, "Default administrator login enabled", "logins", "login_id = 1 AND NOT is_disabled", "server", "name")

    def orphan_users(t):
        users = t["db_users"].where("type = 'S' AND user_id > 4 AND auth = 'INSTANCE'").where("NOT startswith(name, '##MS_')")
        known = t["logins"].where("sid IS NOT NULL").select("server", "sid").distinct()
        return users.where("sid IS NOT NULL").join(known, ["server", "sid"], "left_anti")

    frame(102, usr, "Users without a login", ["db_users", "logins"], orphan_users, "server", "database", "name")
    active = "type = 'S' AND NOT is_disabled"
    row(103, usr, "Logins without password policy", "logins", f"{active} AND (NOT is_policy_checked OR NOT is_expiration_checked)", "server", "name")
    old = f"NOT is_expiration_checked AND days_until_expiration IS NULL AND datediff({now}, password_set) > 180"
    row(104, usr, "Old passwords", "logins", f"{active} AND {old}", "server", "name", "password_set")
    frame(
        105, usr, "Guessable passwords", ["logins"],
        lambda t: dictionary_match(t["logins"].where("type = 'S'"), "password_hash", secret_candidates(t["logins"].select("name"))),
        "server", "name", "word",
    )

    def idle_users(t):
        members = t["role_members"].where("database IS NOT NULL").select("server", "database", F.col("member").alias("name")).distinct()
        granted = t["db_permissions"].where("permission <> 'CONNECT' AND state IN ('G', 'W')")
        granted = granted.select("server", "database", F.col("grantee").alias("name")).distinct()
        users = t["db_users"].where("NOT is_fixed_role AND user_id > 4")
        key = ["server", "database", "name"]
        return users.join(members, key, "left_anti").join(granted, key, "left_anti")

    frame(106, usr, "Users without any right", ["db_users", "role_members", "db_permissions"], idle_users, "server", "database", "name")
    row(107, usr, "Domain sessions without Kerberos", "sessions", "login_type = 'WINDOWS_LOGIN' AND auth_scheme <> 'KERBEROS'", "server", "login")
    row(108, usr, "Everybody sees all databases", "server_permissions", "grantee = 'public' AND permission = 'VIEW ANY DATABASE' AND state IN ('G', 'W')", "server")
    row(109, usr, "Built-in groups as logins", "logins", "startswith(upper(name), 'BUILTIN')", "server", "name")
    row(110, usr, "Local machine groups as logins", "logins", "type = 'G' AND startswith(lower(name), lower(server))", "server", "name")
    stock = "permission = 'VIEW ANY DATABASE' AND class = 'SERVER' OR permission = 'CONNECT' AND class = 'ENDPOINT' AND target IN ('2', '3', '4', '5')"
    row(111, usr, "Rights of public", "server_permissions", f"grantee = 'public' AND state IN ('G', 'W') AND NOT (state = 'G' AND ({stock}))", "server", "permission")
    row(112, usr, "Job proxies open to public", "proxies", "principal = 'public'", "server", "name")

    row(203, prg, "Unsafe assemblies", "assemblies", "is_user_defined AND permission_set <> 'SAFE_ACCESS'", "server", "database", "name")

    online = "state = 'ONLINE' AND name NOT IN ('master', 'model', 'msdb', 'tempdb')"
    row(300, dat, "Databases without encryption at rest", "databases", f"NOT is_encrypted AND {online}", "server", "name")

    def stale_backups(kind, days, filtered, created):
        def build(t):
            history = t["backups"].select(F.struct("server", "database").alias("entity"), "finish", "type")
            dbs = t["databases"].where(filtered).withColumn("entity", F.struct("server", F.col("name").alias("database")))
            only = F.col("type") == kind if kind else None
            return stale_having(dbs, history, "entity", "finish", days, as_of, created, only)

        return build

    needs = ["databases", "backups"]
    frame(301, dat, "Databases without a recent backup", needs, stale_backups(None, 7, "state = 'ONLINE' AND name <> 'tempdb'", F.col("created")), "server", "name", "days_since")
    row(302, dat, "Backups without encryption", "backups", "NOT is_encrypted", "server", "database", "path")
    full = f"recovery_model = 'FULL' AND {online}"
    frame(303, dat, "Full recovery without log backups", needs, stale_backups("L", 1, full, F.lit("1900-01-01")), "server", "name", "last_seen")
    row(304, dat, "Default data file extensions", "files", "lower(right(path, 3)) IN ('mdf', 'ldf', 'ndf')", "server", "database", "path")
    row(305, dat, "Default backup file extension", "backups", f"device_type IN (2, 5) AND start >= {week_ago} AND lower(right(path, 3)) = 'bak'", "server", "path")

    def disk_only(t):
        b = t["backups"].withColumn("entity", F.struct("server", "database"))
        return only_kind_recently(b, "entity", F.col("device_type") == 2, "start", 7, as_of).select("entity.*", "record_count")

    frame(306, dat, "Backups kept on disk only", ["backups"], disk_only, "server", "database", "record_count")

    def grants(where):
        return lambda t: t["server_permissions"].where(where)

    def live_logins(t, names, key):
        skip = "login_id > 10 AND NOT is_disabled AND name NOT LIKE 'NT SERVICE%' AND name NOT LIKE '##MS_%'"
        logins = t["logins"].where(skip).select("server", F.col("name").alias(key))
        return names.join(logins, ["server", key], "left_semi")

    frame(
        400, per, "Control-level server rights", ["server_permissions", "logins"],
        lambda t: live_logins(t, grants(f"class = 'SERVER' AND state IN ('G', 'W') AND {_in('permission', CONTROL_RIGHTS)}")(t), "grantee"),
        "server", "grantee", "permission",
    )
    frame(
        401, per, "Members of admin roles", ["role_members", "logins"],
        lambda t: live_logins(t, t["role_members"].where("database IS NULL AND " + _in("role", ADMIN_ROLES)), "member"),
        "server", "member", "role",
    )
    row(402, per, "May impersonate any login", "server_permissions", "permission = 'IMPERSONATE ANY LOGIN' AND state = 'G'", "server", "grantee")
    impersonate = "permission = 'IMPERSONATE' AND class = 'SERVER_PRINCIPAL'"
    row(403, per, "May impersonate a login", "server_permissions", f"{impersonate} AND state = 'G'", "server", "grantee", "target")

    def escalation(t):
        edges = t["server_permissions"].where(impersonate).select(_login("grantee").alias("src"), _login("target").alias("dst"))
        return reachable_to(edges, privileged_logins(t)).select("node.*")

    frame(404, per, "Can become an administrator", ["server_permissions", "role_members"], escalation, "server", "login")
    owners = "database IS NOT NULL AND role IN ('db_owner', 'db_securityadmin') AND member NOT IN ('dbo', 'RSExecRole')"
    row(405, per, "Database owners and security admins", "role_members", owners, "server", "database", "member", "role")
    row(406, per, "May impersonate a user", "db_permissions", "permission = 'IMPERSONATE' AND state = 'G'", "server", "database", "grantee")
    row(407, per, "Rights of the public role", "db_permissions", "grantee = 'public' AND state IN ('G', 'W') AND database <> 'tempdb'", "server", "database", "permission")
    system = "database IN ('master', 'tempdb', 'model', 'msdb') AND permission = 'CONNECT'"
    row(408, per, "Rights of the guest user", "db_permissions", f"grantee = 'guest' AND state IN ('G', 'W') AND NOT ({system})", "server", "database", "permission")
    unsafe = "permission IN ('UNSAFE ASSEMBLY', 'EXTERNAL ACCESS ASSEMBLY') AND state IN ('G', 'W')"
    row(409, per, "May load unsafe assemblies", "server_permissions", unsafe, "server", "grantee")
    extended = "database = 'master' AND startswith(object_name, 'xp_') AND object_name NOT IN ('xp_msver', 'xp_qv') AND state IN ('G', 'W')"
    row(410, per, "Rights on extended procedures", "db_permissions", extended, "server", "grantee", "object_name")

    own = "NOT is_shipped AND database <> 'tempdb'"
    row(500, cod, "Modules that run as somebody", "modules", "execute_as IS NOT NULL AND execute_as <> 'dbo' AND NOT is_shipped", "server", "database", "name")
    row(501, cod, "Modules with dynamic statements", "modules", f"{own} AND {_contains_any('definition', DYNAMIC_CODE)}", "server", "database", "name")
    row(502, cod, "Modules calling the shell", "modules", f"{own} AND {_contains_any('definition', ['xp_cmdshell'])}", "server", "database", "name")
    row(503, cod, "Modules using automation objects", "modules", f"{own} AND {_contains_any('definition', ['sp_OACreate', 'sp_OAMethod', 'sp_OAGetProperty'])}", "server", "database", "name")
    row(504, cod, "Startup procedures", "modules", "is_auto_executed", "server", "database", "name")
    row(505, cod, "Modules granting rights", "modules", f"{own} AND {_contains_any('definition', ['grant '])}", "server", "database", "name")
    row(506, cod, "Linked servers with a fixed user", "linked_servers", "is_linked AND NOT uses_self_credential", "server", "name")

    def against_catalog(behind):
        def build(t):
            j = t["servers"].join(t["supported"], "version", "left")
            return j.where("build < latest_build") if behind else j.where("latest_build IS NULL")

        return build

    frame(605, ins, "Version out of support", ["servers", "supported"], against_catalog(False), "server", "version")
    frame(606, ins, "Not the latest build", ["servers", "supported"], against_catalog(True), "server", "build")
    row(607, ins, "Sample databases installed", "databases", _in("name", SAMPLE_DATABASES), "server", "name")
    return [replace(r, how_to_fix=HOW_TO_FIX[r.code], labels={"pt": TITLES_PT[r.code]}) for r in sorted(rules, key=lambda r: r.code)]


def policy_pack(version_property: str = "version") -> list[Rule]:
    """File, trace-flag and property policies; exists rules are judged server by server."""
    from watchloom.operators.rules import exists_rule, range_rule

    sized = "max_size_kb = -1 OR max_size_kb > 83886080 OR growth_type = 'Percent'"
    return [
        Rule(1001, "Policy", "Data file size limits", "data_files", sized, detail=("server", "path")),
        exists_rule(1002, "Policy", "Required trace flag on", "trace_flags", "flag = 1118 AND is_global"),
        exists_rule(1003, "Policy", "Version property present", "properties", "name = '" + version_property.replace("'", "''") + "'"),
        range_rule(1004, "Policy", "Autogrowth step within limits", "data_files", {"growth_mb": (64, 1024)}, ("server", "path")),
    ]
