"""Fixed values of the detector: names and lists that results depend on."""

# Fixed values, in their natural order.
EXTENSIONS = "php js ts jsx tsx py rb java go rs cs cpp c h hpp xml yaml yml json config conf ini env properties toml sql md txt sh bash zsh tf tfvars hcl pem key map mjs cjs"
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Gemfile.lock poetry.lock composer.lock go.sum flake.lock bun.lock"
EXTENSIONLESS = ".npmrc .yarnrc .netrc .pypirc Dockerfile Containerfile Makefile Jenkinsfile credentials id_rsa id_dsa id_ecdsa id_ed25519"
IGNORED_FOLDERS = "node_modules vendor .git target .venv venv __pypackages__ .renv .cargo .gradle .m2 bower_components .bundle coverage __pycache__ .pytest_cache .cache"
QUOTED_ONLY = "js mjs cjs ts jsx tsx rs py rb php java go cs c cpp h hpp kt swift"
CHECKSUM_LABELS = "sha1 sha224 sha256 sha384 sha512 md5 checksum digest integrity"
SEVERITIES = "Critical High Medium Low"
