"""keysieve: find, explain and rank leaked credentials in tables of files, on Spark."""
