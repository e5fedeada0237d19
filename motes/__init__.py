"""motes: analytics over very large tables of picked image particles, on Spark."""
