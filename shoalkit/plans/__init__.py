"""The batch refresh and the parameterised views."""
