"""driftloom.streaming"""
