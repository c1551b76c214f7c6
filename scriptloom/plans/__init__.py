"""Plan compilation, input views and registered queries."""
