"""driftloom.functions"""
