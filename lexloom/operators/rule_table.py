"""The structural rule packs as data."""

from __future__ import annotations

JS = ("javascript", "typescript")
PY = ("python",)
RS = ("rust",)

# Fixed values: (pack, languages, name, severity, pattern). A rule's id is its language and its name.
STRUCTURAL_RULES: tuple[tuple[str, tuple[str, ...], str, str, str], ...] = (
    ("auth", PY, "auth-eval", "high", "eval($$$ARGS)"),
    ("auth", PY, "auth-exec", "high", "exec($$$ARGS)"),
    ("auth", PY, "jwt-encode-hardcoded-secret", "high", 'jwt.encode($PAYLOAD, "$SECRET")'),
    ("auth", PY, "jwt-encode-hardcoded-secret-options", "high", 'jwt.encode($PAYLOAD, "$SECRET", $$$ARGS)'),
    ("auth", PY, "jwt-decode-hardcoded-secret", "high", 'jwt.decode($TOKEN, "$SECRET")'),
    ("auth", PY, "jwt-decode-hardcoded-secret-options", "high", 'jwt.decode($TOKEN, "$SECRET", $$$ARGS)'),
    ("auth", PY, "hardcoded-jwt-secret", "medium", 'JWT_SECRET = "$SECRET"'),
    ("auth", PY, "hardcoded-secret-key", "medium", 'SECRET_KEY = "$SECRET"'),
    ("auth", PY, "hardcoded-flask-jwt-secret", "medium", 'app.config["JWT_SECRET_KEY"] = "$SECRET"'),
    ("auth", JS, "auth-eval", "high", "eval($$$ARGS)"),
    ("auth", JS, "new-function", "high", "new Function($$$ARGS)"),
    ("auth", JS, "jwt-sign-hardcoded-secret", "high", 'jwt.sign($PAYLOAD, "$SECRET")'),
    ("auth", JS, "jwt-sign-hardcoded-secret-options", "high", 'jwt.sign($PAYLOAD, "$SECRET", $$$ARGS)'),
    ("auth", JS, "jwt-verify-hardcoded-secret", "high", 'jwt.verify($TOKEN, "$SECRET")'),
    ("auth", JS, "jwt-verify-hardcoded-secret-options", "high", 'jwt.verify($TOKEN, "$SECRET", $$$ARGS)'),
    ("auth", JS, "hardcoded-jwt-secret", "medium", 'const JWT_SECRET = "$SECRET"'),
    ("auth", JS, "hardcoded-jwt-secret-camel", "medium", 'const jwtSecret = "$SECRET"'),
    ("auth", JS, "hardcoded-express-jwt-secret", "medium", 'app.set("jwtSecret", "$SECRET")'),
    ("auth", RS, "rhai-engine-eval", "high", "rhai::Engine::new().eval($CODE)"),
    ("auth", RS, "rhai-engine-eval-with-scope", "high", "engine.eval($CODE)"),
    ("auth", RS, "mlua-load-exec", "high", "lua.load($CODE).exec()"),
    ("auth", RS, "mlua-load-eval", "high", "lua.load($CODE).eval()"),
    ("auth", RS, "jsonwebtoken-encode-hardcoded-secret", "high", 'EncodingKey::from_secret("$SECRET".as_bytes())'),
    ("auth", RS, "jsonwebtoken-decode-hardcoded-secret", "high", 'DecodingKey::from_secret("$SECRET".as_bytes())'),
    ("auth", RS, "hardcoded-jwt-secret", "medium", 'let jwt_secret = "$SECRET";'),
    ("auth", RS, "hardcoded-secret-key", "medium", 'let secret_key = "$SECRET";'),
    ("crypto", PY, "hashlib-md5", "high", "hashlib.md5($$$ARGS)"),
    ("crypto", PY, "hashlib-sha1", "high", "hashlib.sha1($$$ARGS)"),
    ("crypto", JS, "createhash-md5", "high", "crypto.createHash('md5')"),
    ("crypto", JS, "createhash-sha1", "high", "crypto.createHash('sha1')"),
    ("crypto", RS, "md5-compute", "high", "md5::compute($EXPR)"),
    ("secrets", PY, "hardcoded-password", "medium", 'password = "$SECRET"'),
    ("secrets", PY, "hardcoded-api-key", "medium", 'api_key = "$SECRET"'),
    ("secrets", PY, "hardcoded-api-key-uppercase", "medium", 'API_KEY = "$SECRET"'),
    ("secrets", PY, "hardcoded-token", "medium", 'token = "$SECRET"'),
    ("secrets", JS, "hardcoded-password", "medium", 'const password = "$SECRET"'),
    ("secrets", JS, "hardcoded-api-key", "medium", 'const apiKey = "$SECRET"'),
    ("secrets", JS, "hardcoded-token", "medium", 'const token = "$SECRET"'),
    ("secrets", RS, "hardcoded-password", "medium", 'let password = "$SECRET";'),
    ("secrets", RS, "hardcoded-api-key", "medium", 'let api_key = "$SECRET";'),
    ("secrets", RS, "hardcoded-token", "medium", 'let token = "$SECRET";'),
    ("deserialization", PY, "pickle-load", "high", "pickle.load($$$ARGS)"),
    ("deserialization", PY, "pickle-loads", "high", "pickle.loads($$$ARGS)"),
    ("deserialization", PY, "dill-load", "high", "dill.load($$$ARGS)"),
    ("deserialization", PY, "dill-loads", "high", "dill.loads($$$ARGS)"),
    ("deserialization", PY, "yaml-load", "high", "yaml.load($DATA)"),
    ("deserialization", PY, "yaml-load-unsafe-loader", "high", "yaml.load($DATA, Loader=yaml.Loader)"),
    ("deserialization", PY, "yaml-load-full-loader", "high", "yaml.load($DATA, Loader=yaml.FullLoader)"),
    ("deserialization", PY, "pandas-read-pickle", "high", "pandas.read_pickle($PATH)"),
    ("deserialization", JS, "json-parse-untrusted", "medium", "JSON.parse($INPUT)"),
    ("deserialization", JS, "json-parse-request-body", "high", "JSON.parse(req.body)"),
    ("deserialization", JS, "json-parse-user-input", "high", "JSON.parse(userInput)"),
    ("deserialization", JS, "object-assign-json-parse", "high", "Object.assign({}, JSON.parse($INPUT))"),
    ("deserialization", JS, "lodash-merge-json-parse", "high", "_.merge({}, JSON.parse($INPUT))"),
    ("deserialization", JS, "yaml-load", "high", "yaml.load($DATA)"),
    ("deserialization", RS, "bincode-deserialize", "high", "bincode::deserialize($BYTES)"),
    ("deserialization", RS, "bincode-deserialize-from", "high", "bincode::deserialize_from($READER)"),
    ("deserialization", RS, "serde-json-from-str", "medium", "serde_json::from_str($INPUT)"),
    ("deserialization", RS, "serde-json-from-slice", "medium", "serde_json::from_slice($BYTES)"),
    ("deserialization", RS, "serde-yaml-from-str", "high", "serde_yaml::from_str($INPUT)"),
    ("deserialization", RS, "ron-from-str", "high", "ron::from_str($INPUT)"),
    ("subprocess", PY, "os-system", "high", "os.system($CMD)"),
    ("subprocess", PY, "os-popen", "high", "os.popen($CMD)"),
    ("subprocess", PY, "subprocess-run-shell-true", "high", "subprocess.run($CMD, shell=True)"),
    ("subprocess", PY, "subprocess-call-shell-true", "high", "subprocess.call($CMD, shell=True)"),
    ("subprocess", PY, "subprocess-popen-shell-true", "high", "subprocess.Popen($CMD, shell=True)"),
    ("subprocess", PY, "subprocess-check-call-shell-true", "high", "subprocess.check_call($CMD, shell=True)"),
    ("subprocess", PY, "subprocess-check-output-shell-true", "high", "subprocess.check_output($CMD, shell=True)"),
    ("subprocess", PY, "subprocess-getoutput", "medium", "subprocess.getoutput($CMD)"),
    ("subprocess", PY, "subprocess-getstatusoutput", "medium", "subprocess.getstatusoutput($CMD)"),
    ("subprocess", JS, "child-process-exec", "high", "child_process.exec($CMD)"),
    ("subprocess", JS, "child-process-exec-sync", "high", "child_process.execSync($CMD)"),
    ("subprocess", JS, "exec", "high", "exec($CMD)"),
    ("subprocess", JS, "exec-sync", "high", "execSync($CMD)"),
    ("subprocess", JS, "require-child-process-exec", "high", 'require("child_process").exec($CMD)'),
    ("subprocess", JS, "require-child-process-exec-sync", "high", 'require("child_process").execSync($CMD)'),
    ("subprocess", JS, "spawn-sh", "high", 'spawn("sh", $$$ARGS)'),
    ("subprocess", JS, "spawn-bash", "high", 'spawn("bash", $$$ARGS)'),
    ("subprocess", RS, "command-new-sh", "high", 'Command::new("sh")'),
    ("subprocess", RS, "command-new-bash", "high", 'Command::new("bash")'),
    ("subprocess", RS, "command-new-cmd", "high", 'Command::new("cmd")'),
    ("subprocess", RS, "command-new-powershell", "high", 'Command::new("powershell")'),
    ("subprocess", RS, "std-command-new-sh", "high", 'std::process::Command::new("sh")'),
    ("subprocess", RS, "std-command-new-bash", "high", 'std::process::Command::new("bash")'),
    ("subprocess", RS, "std-command-new-cmd", "high", 'std::process::Command::new("cmd")'),
    ("subprocess", RS, "std-command-new-powershell", "high", 'std::process::Command::new("powershell")'),
    ("tls", PY, "unverified-ssl-context", "high", "ssl._create_unverified_context()"),
    ("tls", PY, "requests-verify-false", "high", "requests.get($URL, verify=False)"),
    ("tls", PY, "requests-post-verify-false", "high", "requests.post($URL, verify=False)"),
    ("tls", JS, "reject-unauthorized-false", "high", "rejectUnauthorized: false"),
    ("tls", RS, "danger-accept-invalid-certs", "high", "danger_accept_invalid_certs(true)"),
)
